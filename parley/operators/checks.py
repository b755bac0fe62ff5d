"""What is wrong with a session's files, before anything is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import roster

#: Shares of a session that a chat should span, of join times that should parse, and of absent people that make a report none;
#: minutes of a session of unknown length.
LEAST_SPAN, LEAST_PARSED, MOST_ABSENT, USUAL = 0.50, 0.75, 0.60, 200.0
CLOCK = "([0-9]{2}):([0-9]{2}):([0-9]{2})"


def _reports(lines: DataFrame) -> DataFrame:
    """room, file_ord, nul, rows, yes, no (both up to this report of the room), joins, parsed, duration_min of each report."""
    file = ["room", "file_ord"]
    rows = roster.attendee_rows(lines, file)
    yes = F.col("cells")["Attended"] == "Yes"
    counts = rows.groupBy(*file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(yes).alias("joins"), F.count_if(~yes).alias("absent"), F.count_if(yes & text.parse_timestamp(F.col("cells")["Join Time"]).isNotNull()).alias("parsed"))
    nul = lines.groupBy(*file).agg(F.sum(F.length("line") - F.length(F.replace("line", F.lit("\0"), F.lit("")))).alias("nul"))
    meta = roster.session_meta(lines, file).select(*file, "duration_min")
    upto = Window.partitionBy("room").orderBy("file_ord")
    found = nul.join(counts, file, "left").join(meta, file, "left").fillna(0, ["rows", "joins", "absent", "parsed"])
    return found.withColumns({"yes": F.sum("joins").over(upto), "no": F.sum("absent").over(upto)})


def _chats(lines: DataFrame) -> DataFrame:
    """room, file_ord, clocks, span of each chat: every time of day in its text, without midnight."""
    times = lines.select("room", "file_ord", F.explode_outer(F.regexp_extract_all("line", F.lit(CLOCK), F.lit(0))).alias("c"))
    second = text.second_of_day(F.col("c"))
    return times.groupBy("room", "file_ord").agg(F.count("c").alias("clocks"), ((F.max(second) - F.min(second)) / 60.0).alias("span"))


def check_rooms(reports: DataFrame, chats: DataFrame) -> DataFrame:
    """room, attended, level (ok, WARN or FAIL), messages, from room, file_ord, line_no, line of reports and chats.

    A FAIL means that results would be lost or degraded without a word; processing is still allowed.
    """
    n = lambda c, of="%.0f": F.format_string(of, c.cast("double"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    told = lambda *rules: F.array_compact(F.array(*(F.when(c, F.struct(F.lit(level).alias("level"), m.alias("m"))) for c, level, m in rules)))
    absent = F.col("no") / F.greatest(F.col("yes") + F.col("no"), F.lit(1))
    some = F.col("rows") > 0
    own = _reports(reports).withColumn("told", told(
        (F.col("nul") > 0, "WARN", F.concat(n(F.col("nul")), F.lit(" NUL byte(s) in the attendee report were repaired"))),
        (~some, "FAIL", F.lit("attendee report has no rows")),
        (some & (absent > MOST_ABSENT), "FAIL", F.concat(n(100 * absent), F.lit("% of rows did not attend"))),
        (some & (F.col("joins") > 0) & (share("parsed", "joins") < LEAST_PARSED), "FAIL", F.concat(F.lit("only "), n(100 * share("parsed", "joins")), F.lit("% of join times parse"))),
    ))
    by_room = own.groupBy("room").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "told"))), lambda f: f["told"])).alias("of_reports"), F.sum("joins").alias("attended"), F.max_by("duration_min", F.when(some, F.col("file_ord"))).alias("minutes"))
    talk = _chats(chats).groupBy("room").agg(F.array_sort(F.collect_list(F.struct("file_ord", "clocks", "span"))).alias("chats"))
    rooms = by_room.join(talk, "room", "full_outer").withColumn("minutes", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(USUAL))

    def of_chat(c):
        early = F.concat(F.lit("chat spans "), n(c["span"]), F.lit(" of about "), n(F.col("minutes")), F.lit(" min"))
        return F.when(c["clocks"] < 2, F.lit("chat has no times")).when(c["span"] < LEAST_SPAN * F.col("minutes"), early)

    said = F.transform(F.array_compact(F.transform("chats", of_chat)), lambda m: F.struct(F.lit("FAIL").alias("level"), m.alias("m")))
    fail = lambda m: F.array(F.struct(F.lit("FAIL").alias("level"), F.lit(m).alias("m")))
    every = F.concat(F.coalesce("of_reports", fail("no attendee report")), F.coalesce(said, fail("no chat export")))
    level = lambda x: F.exists(every, lambda t: t["level"] == x)
    return rooms.select("room", F.coalesce("attended", F.lit(0)).cast("long").alias("attended"), F.when(level("FAIL"), "FAIL").when(level("WARN"), "WARN").otherwise("ok").alias("level"), F.transform(every, lambda t: t["m"]).alias("messages"))
