"""Which person wrote which message: equi-joins on room and name, an interval residual for shared names, nothing guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import chatlog

GRACE, HOUR = 90, 3600
#: People of one list of messages that a task makes rows for.
TOGETHER = 256


def _of_host(raw: str, norm: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(chatlog.is_host(F.col(raw), F.col(norm), names), F.lit(False))


def without_hosts(blocks: DataFrame, raw: str = "sender", norm: str = "norm", names: tuple[str, ...] = chatlog.HOSTS) -> DataFrame:
    """The blocks that are to be attributed: those of hosts and note takers are nobody's."""
    return blocks.filter(~_of_host(raw, norm, names))


def host_blocks(blocks: DataFrame, raw: str = "sender", norm: str = "norm", names: tuple[str, ...] = chatlog.HOSTS) -> DataFrame:
    """room, host_blocks: how many blocks ``without_hosts`` leaves out, for every room of the blocks."""
    return blocks.groupBy("room").agg(F.count_if(_of_host(raw, norm, names)).alias("host_blocks"))


def name_variants(records: DataFrame) -> DataFrame:
    """room, norm, key_email, j, l: each name that an attended record with a usable key was in the room under, and when.

    Reads room, key_email, attended_flag, orig, name_rows (raw_name, j, l: the attended rows) and segments (j, l).  Only names
    as they are written count; a record without such a row has its last name for all its time.  People who never joined are
    no candidates, so that they make no name ambiguous.
    """
    own = records.filter("attended_flag AND key_email <> ''")
    whole = F.transform(F.when(F.size("segments") > 0, F.transform("segments", lambda s: F.struct(s["j"].alias("j"), s["l"].alias("l")))).otherwise(F.array(F.struct(*(F.lit(None).cast("timestamp_ntz").alias(c) for c in "jl")))), lambda s: F.struct(F.col("orig").alias("raw_name"), s["j"].alias("j"), s["l"].alias("l")))
    named = F.transform("name_rows", lambda r: F.struct(r["raw_name"].alias("raw_name"), r["j"].alias("j"), r["l"].alias("l")))
    rows = own.select("room", "key_email", F.explode(F.when(F.size("name_rows") > 0, named).otherwise(F.filter(whole, lambda r: r["raw_name"] != ""))).alias("v"))
    seconds = lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)
    both = F.col("v.j").isNotNull() & F.col("v.l").isNotNull()
    named = rows.select("room", text.norm_name(text.nfkc("v.raw_name")).alias("norm"), "key_email", F.when(both, seconds(F.col("v.j"))).alias("j"), F.when(both, seconds(F.col("v.l"))).alias("l"))
    return named.filter("norm <> ''")


def candidates(segments: DataFrame) -> DataFrame:
    """room, norm, key_email, n: who can be meant by a name, and how many.  Reads room, norm, key_email."""
    each = segments.filter("key_email <> '' AND norm <> ''").select("room", "norm", "key_email").distinct()
    count = F.count(F.lit(1)).over(Window.partitionBy("room", "norm"))
    return each.withColumn("n", count)


def attributed(blocks: DataFrame, segments: DataFrame, grace: int = GRACE) -> DataFrame:
    """The blocks (room, norm, block_id, t) with key_email and how: unique, window, ambiguous or no_row.

    A name with one candidate needs no time.  Of a shared name the one candidate whose presence, widened by ``grace``
    seconds, covers the block gets it; with none or several it is ambiguous.  Blocks meet presences by room, name and hour, so
    a frequent name is dealt over its hours and a block meets only who was there then.
    """
    cands = candidates(segments)
    names = cands.groupBy("room", "norm").agg(F.max("n").alias("n"), F.min("key_email").alias("only"))
    found = blocks.join(names, ["room", "norm"], "left")
    shared = found.filter("n > 1 AND t IS NOT NULL").select("room", "norm", "block_id", "t", F.floor(F.col("t") / HOUR).alias("hour"))
    # No presence is dealt over more hours than the room's chat has.
    talk = blocks.groupBy("room").agg(F.min("t").alias("from"), F.max("t").alias("to"))
    live = segments.filter("key_email <> '' AND j IS NOT NULL AND l IS NOT NULL").join(names.filter("n > 1").select("room", "norm"), ["room", "norm"], "left_semi").join(talk, "room")
    live = live.withColumns({"j": F.col("j") - grace, "l": F.col("l") + grace}).withColumns({"a": F.greatest("j", "from"), "b": F.least("l", "to")}).filter("a <= b")
    live = live.select("room", "norm", "key_email", "j", "l", F.explode(F.sequence(F.floor(F.col("a") / HOUR), F.floor(F.col("b") / HOUR))).alias("hour"))
    here = live.groupBy("room", "norm", "hour", "key_email").agg(F.collect_list(F.struct("j", "l")).alias("there"))
    covers = F.exists("there", lambda s: (F.col("t") >= s["j"]) & (F.col("t") <= s["l"]))
    one = (
        shared.join(here, ["room", "norm", "hour"])
        .filter(covers)
        .groupBy("room", "norm", "block_id")
        .agg(F.min("key_email").alias("one"), F.max("key_email").alias("other"))
        .filter("one = other")
        .select("room", "norm", "block_id", "one")
    )
    how = F.when(F.col("n").isNull(), "no_row").when(F.col("n") == 1, "unique").when(F.col("one").isNotNull(), "window").otherwise("ambiguous")
    out = found.join(one, ["room", "norm", "block_id"], "left").withColumn("how", how)
    key = F.when(F.col("how") == "unique", F.col("only")).when(F.col("how") == "window", F.col("one"))
    return out.withColumn("key_email", key).drop("n", "only", "one")


def stats(attributed: DataFrame) -> DataFrame:
    """room and the counters: lines by outcome, senders by outcome."""
    lines = lambda how: F.sum(F.when(F.col("how") == how, F.col("n_lines")).otherwise(0))
    by_sender = attributed.groupBy("room", "norm").agg(
        *(lines(h).alias(f"l_{h}") for h in ("unique", "window", "ambiguous", "no_row")),
        *(F.bool_or(F.col("how") == h).alias(h) for h in ("unique", "window", "ambiguous", "no_row")),
    )
    one = lambda c: F.count_if(c)
    return by_sender.groupBy("room").agg(
        F.sum("l_unique").alias("msg_unique"),
        F.sum("l_window").alias("msg_time_resolved"),
        F.sum("l_ambiguous").alias("msg_still_ambiguous"),
        F.sum("l_no_row").alias("msg_no_csv_row"),
        one(F.col("unique")).alias("sender_unique"),
        one(F.col("window")).alias("sender_time_resolved"),
        one(F.col("ambiguous") & ~F.col("window")).alias("sender_unresolved"),
        one(F.col("no_row")).alias("sender_no_csv_row"),
    )


def unmatched_senders(attributed: DataFrame) -> DataFrame:
    """room, norm, n_blocks of the names that no attendee of the room has."""
    return attributed.filter("how = 'no_row'").groupBy("room", "norm").agg(F.count(F.lit(1)).alias("n_blocks"))


def unattributed_pool(attributed: DataFrame, segments: DataFrame) -> DataFrame:
    """room, key_email, n_lines, n_candidates: ambiguous lines go to every candidate of the name, to be shown only.

    Lines are summed for each name before they meet its candidates, so a shared name costs one row for each candidate.
    """
    left = attributed.filter("how = 'ambiguous'").groupBy("room", "norm").agg(F.sum("n_lines").alias("n_lines"))
    rows = left.join(candidates(segments), ["room", "norm"])
    return rows.groupBy("room", "key_email").agg(F.sum("n_lines").alias("n_lines"), F.max("n").alias("n_candidates"))


def unattributed_lines(attributed: DataFrame, segments: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """room, key_email, lines, n_candidates: the ambiguous messages themselves for every candidate, to be shown only.

    Reads block_id and lines besides.  Lines are in order of the sender's first block, then of block and line.  ``only``: the
    key_email that are wanted.  A list is made once for all people of the same names; it meets them last, ``TOGETHER`` at a
    time, so each long row is made, handed on and forgotten.
    """
    mine = F.when(F.col("how") == "ambiguous", F.struct("block_id", "lines"))
    names = attributed.groupBy("room", "norm").agg(F.min("block_id").alias("first"), F.array_sort(F.collect_list(mine)).alias("left")).filter("size(left) > 0")
    said = names.select("room", "norm", "first", F.flatten(F.transform("left", lambda b: b["lines"])).alias("lines"))
    shared = candidates(segments).filter("n > 1")
    if only is not None:
        shared = shared.join(only.select("key_email").distinct(), "key_email", "left_semi")
    people = shared.groupBy("room", "key_email").agg(F.array_sort(F.collect_list(F.struct("norm", "n"))).alias("names"))
    lists = people.groupBy("room", "names").agg(F.count(F.lit(1)).alias("people"))
    rows = lists.select("room", "names", "people", F.inline("names")).join(said, ["room", "norm"])
    pool = F.array_sort(F.collect_list(F.struct("first", "norm", "lines")))
    made = rows.groupBy("room", "names", "people").agg(pool.alias("pool"), F.max("n").alias("n_candidates"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("people") - 1) / TOGETHER)))
    made = made.select("room", "names", F.flatten(F.transform("pool", lambda p: p["lines"])).alias("lines"), "n_candidates", parts.alias("part"))
    place = F.row_number().over(Window.partitionBy("room", "names").orderBy("key_email"))
    return people.withColumn("part", F.floor((place - 1) / TOGETHER)).join(made.hint("merge"), ["room", "names", "part"]).select("room", "key_email", "lines", "n_candidates")


def chatted_winners(blocks: DataFrame, winners: DataFrame) -> DataFrame:
    """room, rec_key of the records whose name chatted, whoever the messages are attributed to (engine_chatted)."""
    return winners.join(blocks.select("room", "norm").distinct(), ["room", "norm"], "left_semi").select("room", "rec_key").distinct()


def session_counters(attributed: DataFrame, people: DataFrame, borrowed: DataFrame) -> DataFrame:
    """One row: msg_key_not_in_people, lines of keys that are no person's (gk); phone_fallback_rows."""
    known = people.select(F.col("gk").alias("key_email")).distinct()
    lost = attributed.filter("key_email IS NOT NULL").join(known, "key_email", "left_anti")
    lines = lost.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).cast("long").alias("msg_key_not_in_people"))
    return lines.crossJoin(borrowed.agg(F.count(F.lit(1)).alias("phone_fallback_rows")))


def winners(records: DataFrame) -> DataFrame:
    """room, norm, rec_key: whose name it is: own names before aliases, then longest presence, then first record."""
    own = records.filter("attended_flag")
    rows = own.select("room", F.col("norm"), F.lit(1).alias("own"), "minutes", "rec_ord", "rec_key").unionByName(
        own.select("room", F.col("alias").alias("norm"), F.lit(0).alias("own"), "minutes", "rec_ord", "rec_key")
    )
    rank = F.struct("own", "minutes", (-F.col("rec_ord")).alias("o"))
    return rows.filter("norm <> ''").groupBy("room", "norm").agg(F.max_by("rec_key", rank).alias("rec_key"))


def phone_owners(phones: DataFrame, receivers: DataFrame) -> DataFrame:
    """phone, owner for phones that exactly one chat receiver has, in each room and over all.

    phones: room, key_email, phone.  receivers: room, key_email.
    """
    rooms = _receivers_by_phone(phones, receivers).filter("n = 1")
    return rooms.groupBy("phone").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner")).filter("n = 1").select("phone", "owner")


def phones_dropped_shared(phones: DataFrame, receivers: DataFrame) -> DataFrame:
    """room, phones_dropped_shared: phones that several chat receivers of the room have, for rooms with a receiver's phone."""
    return _receivers_by_phone(phones, receivers).groupBy("room").agg(F.count_if(F.col("n") > 1).alias("phones_dropped_shared"))


def _receivers_by_phone(phones: DataFrame, receivers: DataFrame) -> DataFrame:
    own = phones.filter("phone <> ''").join(receivers.distinct(), ["room", "key_email"], "left_semi").select("room", "phone", "key_email").distinct()
    return own.groupBy("room", "phone").agg(F.count(F.lit(1)).alias("n"), F.min("key_email").alias("owner"))


def phone_fallback(people: DataFrame, owners: DataFrame, with_blocks: DataFrame) -> DataFrame:
    """gk, borrowed_from: attended people without messages whose phone is that of one person who has some."""
    has = with_blocks.select("gk").distinct()
    quiet = people.filter("attended AND phone <> ''").join(has, "gk", "left_anti")
    lent = owners.join(has.withColumnRenamed("gk", "owner"), "owner", "left_semi")
    return quiet.join(lent, "phone").filter("owner <> gk").select("gk", F.col("owner").alias("borrowed_from"))
