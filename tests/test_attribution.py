"""Counters, pools and windows of attribution on an invented room."""

import datetime

from pyspark.sql import functions as F

from parley.operators import attribution, cleaner, people

BLOCKS = [
    (1, "Sam", "sam", 100, ["a", "b"]), (2, "Al", "al", 100, ["c"]), (3, "Sam", "sam", 200, ["d"]), (4, "Host", "host", 100, ["h"]),
    (5, "Fireflies Notetaker", "x fireflies", 100, ["n"]), (6, "Zed", "zed", 100, ["z"]), (7, "Una", "una", 100, ["u", "v"]),
]
SEGMENTS = [("al", "p@x", 0, 900), ("al", "q@x", 0, 900), ("sam", "p@x", 0, 900), ("sam", "r@x", 0, 900), ("host", "h@x", 0, 900), ("una", "u@x", 0, 900)]


def test_hosts_pool_and_counters(spark):
    blocks = spark.createDataFrame([("R", *b, len(b[-1])) for b in BLOCKS], "room string, block_id int, sender string, norm string, t int, lines array<string>, n_lines int").repartition(3)
    segments = spark.createDataFrame([("R", *s) for s in SEGMENTS], "room string, norm string, key_email string, j int, l int")
    assert attribution.host_blocks(blocks).collect() == [("R", 2)]
    said = attribution.without_hosts(blocks)
    found = attribution.attributed(said, segments)
    counts = attribution.stats(found).first()
    assert (counts["msg_unique"], counts["msg_still_ambiguous"], counts["msg_no_csv_row"]) == (2, 4, 1)
    pool = {r["key_email"]: (r["lines"], r["n_candidates"]) for r in attribution.unattributed_lines(found, segments).collect()}
    assert pool == {"p@x": (["a", "b", "d", "c"], 2), "q@x": (["c"], 2), "r@x": (["a", "b", "d"], 2)}
    winners = spark.createDataFrame([("R", "sam", "k1"), ("R", "host", "k2"), ("R", "mute", "k3")], "room string, norm string, rec_key string")
    assert attribution.chatted_winners(said, winners).collect() == [("R", "k1")]
    persons = spark.createDataFrame([("p@x",)], "gk string")
    borrowed = spark.createDataFrame([("a", "b")], "gk string, borrowed_from string")
    assert attribution.session_counters(found, persons, borrowed).collect() == [(2, 1)]
    assert attribution.session_counters(found.limit(0), persons, borrowed.limit(0)).collect() == [(0, 0)]
    phones = spark.createDataFrame([("R", "p@x", "1"), ("R", "q@x", "1"), ("R", "r@x", "2"), ("R", "mute@x", "2")], "room string, key_email string, phone string")
    receivers = phones.filter("key_email <> 'mute@x'").select("room", "key_email")
    assert attribution.phones_dropped_shared(phones, receivers).collect() == [("R", 1)]
    assert attribution.phone_owners(phones, receivers).collect() == [("2", "r@x")]


def test_windows_and_strict_rel(spark):
    at = datetime.datetime(2026, 8, 2, 10, 50)
    rows = spark.createDataFrame([(at,), (None,)], "s timestamp_ntz")
    got = rows.select(*people.window(F.col("s"), 1.5), *people.window(F.col("s"), (3, 4)), *people.window(F.col("s"), None)).collect()
    after = lambda m: at + datetime.timedelta(minutes=m)
    assert [tuple(r) for r in got] == [(after(1.5), after(11.5), after(3), after(4), None, None), (None,) * 6]
    said = spark.createDataFrame([("p", 1, "what is the fees??"), ("p", 2, "MB MB MB")], "p string, o int, m string")
    assert cleaner.process_messages(said, "p", "o", "m").first()["strict_rel"] == 1


def test_namesakes_share_one_list(spark):
    """A list of messages is made once for all who may have written it and meets them last, a part of them at a time."""
    n = attribution.TOGETHER + 44
    segments = spark.range(n).selectExpr("'R' AS room", "'al' AS norm", "concat('p', id) AS key_email", "0 AS j", "900 AS l").unionByName(
        spark.createDataFrame([("R", "sam", "p1", 0, 900), ("R", "sam", "q", 0, 900), ("R", "una", "q", 0, 900)], "room string, norm string, key_email string, j int, l int"))
    blocks = spark.createDataFrame([("R", k, norm, 100, [f"m{k}"], 1) for k, norm in enumerate(["al", "sam", "una", "al"])], "room string, block_id int, norm string, t int, lines array<string>, n_lines int")
    rows = attribution.unattributed_lines(attribution.attributed(blocks, segments), segments)
    found = {r["key_email"]: (r["lines"], r["n_candidates"]) for r in rows.collect()}
    assert found == {f"p{k}": (["m0", "m3"], n) for k in range(n)} | {"p1": (["m0", "m3", "m1"], n), "q": (["m1"], 2)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")
    only = spark.createDataFrame([("p1",)], "key_email string")
    assert [r["lines"] for r in attribution.unattributed_lines(attribution.attributed(blocks, segments), segments, only).collect()] == [["m0", "m3", "m1"]]
