"""One row for each person of a session, from the records of its rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def room_key(key_email: Column, email: Column, rec_key: Column, room: Column) -> Column:
    """The person's key: the match key, else the address, else the record's key in its room."""
    return F.when(key_email != "", key_email).when(email != "", F.concat(F.lit("em:"), email)).otherwise(F.concat(rec_key, F.lit("#"), room))


def window(start: Column, offset: float | tuple[float, float] | None, minutes: float = 10) -> tuple[Column, Column]:
    """Begin and end of a window: from ``offset`` minutes after the start for ``minutes``, or from one offset to the other; null without either."""
    if offset is None:
        return F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    low, high = offset if isinstance(offset, (tuple, list)) else (offset, offset + minutes)
    after = lambda m: start + F.make_dt_interval(secs=F.lit(round(m * 60, 6)).cast("decimal(18,6)"))
    return after(low), after(high)


def present_in(segments: Column, low: Column, high: Column) -> Column:
    """Whether any (j, l) meets the window; null without a window or segments."""
    return F.when(low.isNotNull() & (F.size(segments) > 0), F.exists(segments, lambda s: (s["j"] <= high) & (s["l"] >= low)))


def fold(records: DataFrame) -> DataFrame:
    """gk, name, email, phone, country, attended, minutes, rooms, person_ord, pricing; and cta, duration_min (the longest), no_timing
    where the records have them.

    Records are folded in order (room, rec_ord): a name is replaced by a later one whose record has at least the minutes that
    were summed before it; the first non-blank address, phone and country stay; rooms are listed by minutes.
    """
    order = Window.partitionBy("gk").orderBy("room", "rec_ord")
    before = F.coalesce(F.sum("minutes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.max(F.when(F.col("name") != "", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = records.withColumn("_ord", F.row_number().over(order)).withColumn("_renames", (F.col("name") != "") & ((F.col("minutes") >= before) | (earlier == 0)))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("_ord"))), F.lit(""))
    room = F.struct((-F.col("minutes")).alias("m"), F.col("_ord").alias("o"), "room")
    return rows.groupBy("gk").agg(
        F.coalesce(F.max_by("name", F.when(F.col("_renames"), F.col("_ord"))), F.lit("")).alias("name"),
        first("email").alias("email"),
        first("phone").alias("phone"),
        first("country").alias("country"),
        F.bool_or("attended").alias("attended"),
        F.sum("minutes").alias("minutes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(room)), lambda r: r["room"]), " | ").alias("rooms"),
        F.min(F.struct("room", "rec_ord")).alias("person_ord"),
        F.bool_or("pricing").alias("pricing"),
        *(f(c).alias(c) for c, f in (("cta", F.bool_or), ("duration_min", F.max), ("no_timing", F.bool_or)) if c in records.columns),
    )


def percent_attended(minutes: Column, duration: Column, no_timing: Column) -> Column:
    """Of the session's length; null where the length is unknown or an attended person has no times at all."""
    share = text.round_tenth(F.least(F.lit(100.0), 100.0 * minutes / duration))
    return F.when((~no_timing | (minutes > 0)) & (duration > 0), share)


def shown(results: DataFrame) -> DataFrame:
    """The columns of a results table: short names, messages as arrays."""
    said = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " \\| "), lambda m: m != "")
    phone = F.when(F.col("phone") != "", F.trim(F.concat("cc", F.lit(" "), "phone"))).otherwise("")
    return results.select(F.col("name").alias("n"), F.col("email").alias("e"), phone.alias("p"), F.col("category").alias("cat"), "basis", F.col("pricing").alias("pr"), F.col("cta").alias("ct"), F.col("minutes").alias("min"), "room", F.col("attended").alias("att"), F.col("msg_count").alias("msgs"), said(F.col("relevant")).alias("rel"), said(F.col("deleted")).alias("del"))


def matching(results: DataFrame, category: str | None = None, query: str | None = None) -> DataFrame:
    """The results of a category and with a part of name or address; their count is a page's total."""
    rows = results
    if category:
        rows = rows.filter(F.col("category") == category)
    if query and query.strip():
        q = query.strip().lower()
        rows = rows.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("email"), F.lit(q)))
    return rows


def page(results: DataFrame, order: list, category: str | None = None, query: str | None = None, offset: int = 0, limit: int = 120) -> DataFrame:
    """A slice of the results: by category, by a part of name or address, 1 to 500 rows."""
    return matching(results, category, query).orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))
