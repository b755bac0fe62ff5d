"""Saved chats: header lines, blocks, clocks that pass midnight, files that repeat another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..tables import materialize

HEADER = "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}\\s+)?([0-9]{1,2}:[0-9]{2}:[0-9]{2})\\s+From\\s+(.+?)\\s+to\\s+(.+?):\\s*$"
QUOTE = '^\\s*(?:Replying to |Reacted to |Removed a )"?'
#: Senders that are no attendees; a deployment adds its own names.
HOSTS = ("host", "moderator", "panelist", "panelists")
HOST_PATTERN = "(?iu)fireflies|notetaker|otter\\.ai|read\\.ai|\\bfathom\\b|^\\s*(co[- ]?host|host|moderator|panelists?|organiser|organizer|admin|team)\\s*$"
DAY = 86_400
#: Numbers of lines or blocks of a file that are summed together.
PIECE = 100_000


def looks_like_chat(lines: Column) -> Column:
    """A header among the first 402 lines."""
    return F.exists(F.slice(lines, 1, 402), lambda x: x.rlike(HEADER))


def is_host(raw: Column, norm: Column, names: tuple[str, ...] = HOSTS, pattern: str = HOST_PATTERN) -> Column:
    return norm.isin(*names) | F.coalesce(raw, F.lit("")).rlike(pattern)


def blocks(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, block_id, line_no, sender, ts, sec, lines of each message block (from line_no, line)."""
    return timed(materialize(untimed(lines, file), "headed"), file)


def timed(rows: DataFrame, file: list[str]) -> DataFrame:
    """``untimed`` blocks with ``sec``; blocks without a line, whose clocks count as well, go.

    The rows are read several times, so they are written before.
    """
    return wrapped(rows, file, "block_id").filter(F.size("lines") > 0).drop("clock", "day")


def untimed(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, block_id, line_no, sender, ts, clock, day, lines of each message block.

    A header opens a block and what follows up to the next header is its body; quotes and empty lines go, and so do blocks
    without a line.  Times grow by a day for each day after the file's first date; without a date a jump back of over twelve
    hours is a new day.
    """
    head = F.col("line").rlike(HEADER)
    marked = numbered(lines.withColumn("_head", head.cast("int")), file, "line_no", "_head", "block_id").filter("block_id > 0").drop("_head")
    body = text.strip(F.col("line"))
    # A block's body is as long as one message is; lines keep their order by number.
    said = F.when(~head & ~F.col("line").rlike(QUOTE) & (body != ""), F.struct("line_no", body.alias("x")))
    rows = marked.groupBy(*file, "block_id").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("header"), F.array_sort(F.collect_list(said)).alias("said"))
    part = lambda k: F.regexp_extract("header", HEADER, k)
    day = F.when(F.col("header").rlike("^[0-9]{4}-"), F.left("header", F.lit(10))).try_cast("date")
    return rows.select(*file, "block_id", "line_no", text.strip(part(2)).alias("sender"), part(1).alias("ts"), text.second_of_day(part(1)).alias("clock"), day.alias("day"), F.transform("said", lambda s: s["x"]).alias("lines"))


def numbered(rows: DataFrame, file: list[str], order_by: str, step: str, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``step`` up to each row of its file, in order of a whole number that each row has its own of.

    A file is summed by pieces of ``PIECE`` numbers and the few sums of the pieces are added up, so no task has a whole file.
    """
    piece = F.floor(F.col(order_by) / PIECE)
    before = Window.partitionBy(*file).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*file, piece.alias("_piece")).agg(F.sum(step).alias("_sum"))
    sums = sums.select(*file, "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*file, "_piece").orderBy(order_by)
    own = rows.withColumn("_piece", piece).withColumn("_inside", F.sum(step).over(inside))
    return own.join(sums, [*file, "_piece"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_piece", "_inside", "_before")


def wrapped(rows: DataFrame, file: list[str], order_by: str) -> DataFrame:
    """``sec``: clock plus whole days, by date where there is one, else by jumps back.

    Only files with both kinds of headers need a walk: whether an undated clock after a dated one is a new day depends on how
    many new days there were.  Such a file is a group of its own, as large as one saved chat.
    """
    some = F.col("day").isNotNull()
    kinds = rows.groupBy(*file).agg(F.bool_or(some).alias("_dated"), F.bool_or(~some).alias("_bare"), F.min_by("day", F.when(some, F.col(order_by))).alias("_first"))
    known = rows.join(kinds, file)
    seconds = lambda days: (F.col("clock") + days * DAY).cast("int")
    # With dates throughout each block is told by itself, without its file's order.
    dated = known.filter("_dated AND NOT _bare").withColumn("sec", seconds(F.greatest(F.datediff("day", "_first"), F.lit(0))))
    order = Window.partitionBy(*file).orderBy(order_by)
    back = F.coalesce((F.col("clock") < F.lag("clock").over(order) - DAY // 2).cast("int"), F.lit(0))
    bare = known.filter("NOT _dated").withColumn("_back", back).withColumn("sec", seconds(F.sum("_back").over(order))).drop("_back")
    plain = dated.unionByName(bare).drop("_dated", "_bare", "_first")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_by, kind="stable")
        start, days, last, seconds = None, 0, None, []
        for clock, day in zip(pdf["clock"], pdf["day"]):
            if day is not None and not pd.isna(day):
                start = day if start is None else start
                last = clock + DAY * max(0, (day - start).days)
            else:
                days += last is not None and clock + DAY * days < last - DAY // 2
                last = clock + DAY * days
            seconds.append(last)
        return pdf.assign(sec=seconds)

    mixed = known.filter("_dated AND _bare").drop("_dated", "_bare", "_first").groupBy(*file).applyInPandas(walk, plain.schema)
    return plain.unionByName(mixed)


def drop_contained(blocks: DataFrame, room: str, file: str, norm: str, share: float = 0.9) -> DataFrame:
    """room, file, n_keys, kept: a file goes if ``share`` of its messages are in a larger file of the room that stays.

    A message's key is its second, sender and first 40 characters.  Keys of two files meet by an equi-join; what stays is then
    decided in order of size over the few files of one room.
    """
    key = F.xxhash64("sec", norm, F.left(F.get("lines", F.lit(0)), F.lit(40)))
    keys = blocks.select(room, file, key.alias("k")).distinct()
    sizes = keys.groupBy(room, file).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(room).orderBy(F.desc("n"), file))
    files = sizes.withColumn("rank", rank)
    mine = keys.join(files, [room, file])
    other = mine.select(room, "k", F.col("rank").alias("by"))
    common = mine.join(other, [room, "k"]).filter("by < rank").groupBy(room, "rank", "n", "by").agg(F.count(F.lit(1)).alias("common"))
    inside = common.filter(F.col("common") >= share * F.col("n")).groupBy(room, "rank").agg(F.collect_set("by").alias("inside"))
    per_room = files.join(inside, [room, "rank"], "left").groupBy(room).agg(F.array_sort(F.collect_list(F.struct("rank", file, "n", "inside"))).alias("files"))
    none = F.array().cast("array<int>")
    stays = F.aggregate("files", none, lambda kept, f: F.when(F.arrays_overlap(kept, F.coalesce(f["inside"], none)), kept).otherwise(F.concat(kept, F.array(f["rank"]))))
    out = per_room.withColumn("stays", stays).select(room, "stays", F.inline("files"))
    return out.select(room, file, F.col("n").alias("n_keys"), F.array_contains("stays", F.col("rank")).alias("kept"))


def spans(blocks: DataFrame, room: str) -> DataFrame:
    return blocks.groupBy(room).agg(F.count(F.lit(1)).alias("chat_blocks"), (F.max("sec") - F.min("sec")).alias("span_s"))
