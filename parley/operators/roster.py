"""Attendance reports: sections, records of a person, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact, text

EXACT_HEADER = "Attended,User Name (Original Name),First Name"
NAME, EMAIL = "User Name (Original Name)", "Email"
#: A cell from the comma before it: quoted with what is behind its end, quoted without an end, or bare.
CELL = ',("(?:[^"]++|"")*+"[^,]*+|"(?:[^"]++|"")*+$|[^,]*+)'
QUOTED = '^"((?:[^"]|"")*+)"?(.*)$'
#: Characters of a cell that a reader of comma-separated files takes at most; a line with a longer one is bad.
CELL_MOST = 131_072


def csv_cells(line: Column) -> Column:
    """All cells of one line, of any number; damage costs that line at most.  NUL bytes go."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, "\\x00", "")), F.lit(CELL), F.lit(1))
    inner = lambda c: F.concat(F.replace(F.regexp_extract(c, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, QUOTED, 2))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), inner(c)).otherwise(c))


def numbered_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """line_no, line for each file, its other columns kept."""
    keep = [c for c in files.columns if c != text_col]
    return files.select(*keep, F.posexplode(text.lines(F.col(text_col))).alias("line_no", "line"))


def _shaped(cells: Column) -> Column:
    some = F.array(*map(F.lit, ("First Name", "Phone", "Registration Time")))
    return (text.strip(F.get(cells, F.lit(0))) == "Attended") & F.array_contains(cells, NAME) & F.array_contains(cells, EMAIL) & F.arrays_overlap(cells, some)


def is_header(line: Column) -> Column:
    """Whether an attendee section may begin with the line."""
    return line.startswith(EXACT_HEADER) | F.when(line.startswith("Attended,"), _shaped(csv_cells(line))).otherwise(False)


def sections(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, head, header (cells), end: where each file's attendee section begins and ends; only lines that may be either
    are parsed.

    The header is the first line with the exact beginning, else the last one of attendee shape; the section ends at the next
    section or at a report banner.
    """
    line = F.col("line")
    shaped = _shaped(F.col("cells"))
    stop = F.substring_index("line", ",", 1).isin("Host Details", "Panelist Details") | line.startswith("Report generated")
    marks = lines.filter(line.startswith("Attended,") | stop).withColumn("cells", F.when(line.startswith("Attended,"), csv_cells(line)))
    exact, own = F.when(line.startswith(EXACT_HEADER), F.col("line_no")), F.when(shaped, F.col("line_no"))
    files = marks.groupBy(*file).agg(
        F.min(exact).alias("exact"), F.min_by("cells", exact).alias("exact_cells"), F.max(own).alias("own"), F.max_by("cells", own).alias("own_cells"), F.collect_list(F.when(stop, F.col("line_no"))).alias("stops")
    )
    found = files.select(*file, F.coalesce("exact", "own").alias("head"), F.when(F.col("exact").isNotNull(), F.col("exact_cells")).otherwise(F.col("own_cells")).alias("header"), "stops")
    return found.filter("head IS NOT NULL").withColumn("end", F.array_min(F.filter("stops", lambda n: n > F.col("head")))).drop("stops")


def section_lines(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, line_no, line, cells, names and at (the header's names, each once, and the last place of each) of the lines
    of the attendee section that aren't blank."""
    header = F.transform("header", lambda h, i: F.struct((-i).alias("i"), h.alias("name")))
    names = sections(lines, file).withColumn("names", F.array_distinct("header"))
    at = F.transform("names", lambda n: -F.array_min(F.filter(header, lambda h: h["name"] == n))["i"])
    inside = (F.col("line_no") > F.col("head")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end"))) & (text.strip(F.col("line")) != "")
    rows = lines.join(names.withColumn("at", at), file).filter(inside)
    return rows.select(*file, "line_no", "line", csv_cells(F.col("line")).alias("cells"), "names", "at")


def _bad(cells: Column) -> Column:
    return (F.length("line") > CELL_MOST) & F.exists(cells, lambda c: F.length(c) > CELL_MOST)


def attendee_rows(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, line_no, cells (map by header) of the rows of the attendee section whose first cell is Yes or No."""
    rows = section_lines(lines, file).filter(F.get("cells", F.lit(0)).isin("Yes", "No") & ~_bad(F.col("cells")))
    # The cells are bound, else each column's look-up would parse the line again.
    values = F.element_at(F.transform(F.array("cells"), lambda c: F.transform("at", lambda i: F.coalesce(F.get(c, i), F.lit("")))), 1)
    return rows.select(*file, "line_no", F.map_from_arrays("names", values).alias("cells"))


def parse_counts(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, nul, bad, cand, kept, has_phone_col: what became of the lines of each file's attendee section."""
    kept = F.get("cells", F.lit(0)).isin("Yes", "No") & ~_bad(F.col("cells"))
    rows = section_lines(lines, file).groupBy(*file).agg(F.count_if(F.col("line").contains("\0")).alias("nul"), F.count_if(_bad(F.col("cells"))).alias("bad"), F.count(F.lit(1)).alias("cand"), F.count_if(kept).alias("kept"))
    files = sections(lines, file).select(*file, F.array_contains("header", "Phone").alias("has_phone_col"))
    none = F.lit(0).cast("long")
    return files.join(rows, file, "left").select(*file, *(F.coalesce(c, none).alias(c) for c in ("nul", "bad", "cand", "kept")), "has_phone_col")


def session_meta(lines: DataFrame, file: list[str]) -> DataFrame:
    """``file``, topic, start, duration_min, registrants from the first meta block of each file."""
    head = lines.filter(F.col("line").startswith("Topic,Webinar ID,Actual Start Time")).groupBy(*file).agg(F.min("line_no").alias("at"), F.min_by("line", "line_no").alias("header"))
    follows = lines.select(*file, (F.col("line_no") - 1).alias("at"), "line")
    rows = head.join(follows, [*file, "at"]).withColumns({"names": csv_cells(F.col("header")), "values": csv_cells(F.col("line"))})
    value = lambda name: F.get("values", (F.array_position("names", name) - 1).cast("int"))
    return rows.select(
        *file,
        F.coalesce(F.trim(value("Topic")), F.lit("")).alias("topic"),
        text.parse_timestamp(value("Actual Start Time")).alias("start"),
        F.coalesce(value("Actual Duration (minutes)").try_cast("double"), F.lit(0.0)).alias("duration_min"),
        F.coalesce(value("# Registrants").try_cast("int"), F.lit(0)).alias("registrants"),
    )


def typed_rows(rows: DataFrame) -> DataFrame:
    """The raw rows with name, email, phone, times and the person's key, which is null for rows to ignore."""
    cell = lambda name: F.coalesce(F.col("cells")[name], F.lit(""))
    typed = rows.select(
        *[c for c in rows.columns if c != "cells"],
        (F.lower(F.trim(cell("Attended"))) == "yes").alias("attended"),
        cell(NAME).alias("raw_name"),
        text.clean_display_name(cell(NAME)).alias("name"),
        *(F.trim(cell(f"{k} Name")).alias(f"{k.lower()}_name") for k in ("First", "Last")),
        text.clean_email(cell(EMAIL)).alias("email"),
        contact.norm_phone(cell("Phone")).alias("phone"),
        F.trim(cell("Phone")).alias("phone_raw"),
        F.trim(cell("Country/Region Name")).alias("country"),
        text.parse_timestamp(cell("Join Time")).alias("j"),
        text.parse_timestamp(cell("Leave Time")).alias("l"),
        text.parse_timestamp(cell("Registration Time")).alias("reg_time"),
        *(F.trim(cell(f"{k} Time")).alias(f"{k.lower()}_raw") for k in ("Join", "Leave")),
    )
    bad = lambda raw, t: ~F.col(raw).isin("", "-", "--") & F.col(t).isNull()
    typed = typed.withColumn("unparsed_ts", bad("join_raw", "j") | bad("leave_raw", "l")).withColumn("norm", text.norm_name(text.nfkc("name")))
    key = F.when(F.col("email") != "", F.col("email")).when(F.col("norm") != "", F.concat(F.lit("name:"), "norm")).when(F.col("phone") != "", F.concat(F.lit("ph:"), "phone"))
    return typed.drop("join_raw", "leave_raw").withColumn("rec_key", key)


def records(rows: DataFrame, file: list[str]) -> DataFrame:
    """One record for each ``file`` and person: last or first non-blank values, flags, presence segments."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("line_no"))), F.lit(""))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("line_no"))), F.lit(""))
    whole = F.col("j").isNotNull() & F.col("l").isNotNull()
    segment = F.struct("line_no", "j", "l")
    grouped = (
        rows.filter("rec_key IS NOT NULL")
        .groupBy(*file, "rec_key")
        .agg(
            F.min("line_no").alias("rec_ord"),
            F.max_by("email", "line_no").alias("email"),
            last("name").alias("name"),
            last("raw_name").alias("orig"),
            last("country").alias("country"),
            first("phone").alias("phone"),
            first("phone_raw").alias("phone_raw"),
            F.bool_or("attended").alias("attended_flag"),
            F.bool_or("unparsed_ts").alias("unparsed_ts"),
            last("first_name").alias("first_name"),
            last("last_name").alias("last_name"),
            F.min_by("reg_time", F.when(F.col("reg_time").isNotNull(), F.col("line_no"))).alias("reg_time"),
            F.array_sort(F.collect_list(F.when(F.col("attended") & (F.col("raw_name") != ""), F.struct("line_no", "raw_name", "j", "l")))).alias("name_rows"),
            F.array_sort(F.collect_list(F.when(whole, segment))).alias("segments"),
        )
    )
    seconds = merged_seconds(F.transform("segments", lambda s: F.struct(s["j"].alias("j"), s["l"].alias("l"))))
    return grouped.select(
        *grouped.columns,
        F.col("reg_time").isNotNull().alias("pre_registered"),
        seconds.alias("seconds_present"),
        F.greatest(F.size("segments") - 1, F.lit(0)).alias("reconnections"),
        F.array_min(F.transform("segments", lambda s: s["j"])).alias("first_join"),
        F.array_max(F.transform("segments", lambda s: s["l"])).alias("last_leave"),
    )


def merged_seconds(segments: Column) -> Column:
    """Seconds that the union of an array of (j, l) covers; a person's segments are few."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("timestamp_ntz").alias("end"))
    ordered = F.array_sort(F.filter(segments, lambda s: s["l"] >= s["j"]))

    def add(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["j"], acc["end"])
        more = F.when(s["l"] > begin, F.timestamp_diff("SECOND", begin, s["l"])).otherwise(F.lit(0))
        return F.struct((acc["total"] + more).cast("long").alias("total"), F.greatest(acc["end"], s["l"]).alias("end"))

    return F.aggregate(ordered, zero, add, lambda acc: acc["total"])


def interval_union(segments: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys`` and islands, covered (units of start and end) by gaps and islands: for keys with many segments.

    One shuffle on the keys serves the running maximum, the island numbers and both sums.
    """
    rows = segments.filter(F.col(end) >= F.col(start))
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True)).cast("int")
    islands = rows.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(upto))
    each = islands.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_length"))
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("islands"), F.sum("_length").alias("covered"))


def richer(records: DataFrame, keys: list[str], measure: str, order: str) -> DataFrame:
    """Of several reports of a room the record with the larger measure; the earlier one if they tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(measure), order)
    return records.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
