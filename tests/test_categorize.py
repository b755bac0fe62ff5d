"""Signals and categories of invented people."""

from pyspark.sql import functions as F

from parley.operators import categorize, scoring, signals

MESSAGES = {
    "buyer": ["how to pay the fees", "payment link not working"],
    "paid": ["i have paid for the program"],
    "angry": ["this is a scam", "waste of time"],
    "topic": ["how can we detect fraud with this?", "what is the syllabus"],
    "greets": ["yes", "ok", "hindi"],
    "tech": ["no audio", "screen not visible please"],
    "asks": ["what is a prompt?", "how do we save it"],
    "price": ["what is the price"],
    "quip": ["wow amazing", "bakwas", "super session"],
    "tool": ["is this tool free or paid?"],
    "silent": [],
    "absent": [],
}


def test_categories(spark):
    rows = spark.createDataFrame([(p, m) for p, ms in MESSAGES.items() for m in ms], "p string, m string")
    sums = signals.person_signals(rows, "p", "m")
    people = spark.createDataFrame([(p, p != "absent", bool(ms), 80.0, True, None, False, False) for p, ms in MESSAGES.items()], "p string, attended boolean, chatted boolean, pct double, cta boolean, pricing boolean, orphan boolean, no_text boolean")
    mean = F.when(F.col("p").isin("asks", "topic"), 2).otherwise(0)
    people = people.withColumns({d: F.lit(0) for d in ("D1", "D3", "D4", "D5", "D7", "intent", "neg")}).withColumn("mean", mean).join(sums, "p", "left")
    got = {r["p"]: (r["category"], r["basis"]) for r in categorize.categorized(people).collect()}
    want = {
        "buyer": categorize.HIGH, "paid": categorize.HIGH, "angry": categorize.NEGATIVE, "topic": categorize.HIGH, "greets": categorize.UNCLEAR, "tech": categorize.UNCLEAR,
        "asks": categorize.SEEKING, "price": categorize.STRONG, "quip": categorize.UNCLEAR, "tool": categorize.SEEKING, "silent": categorize.SILENT, "absent": categorize.ABSENT,
    }
    assert {p: c for p, (c, _) in got.items()} == want
    assert got["paid"][1] == "payment-confirmation in chat; stayed to CTA"
    assert got["silent"][1] == "no chat messages; watched 80% of session, stayed to CTA"
    counts = {r["p"]: r for r in sums.collect()}
    assert counts["topic"]["sneg"] == 0 and counts["angry"]["sneg"] == 2 and counts["quip"]["quip"] == 1 and counts["tool"]["toolp"] == 1
    assert signals.person_signals(rows.limit(0), "p", "m").count() == 0


def test_the_programmes_own_names(spark):
    rows = spark.createDataFrame([("a", "enrolled in the mastery"), ("b", "enrolled in the academy"), ("c", "mastery kitne ka hai?")], "p string, m string")
    named = {r["p"]: r for r in signals.person_signals(rows, "p", "m", "mastery").collect()}
    assert (named["a"]["pay"], named["b"]["pay"]) == (1, 0)
    assert {r["p"]: r["pay"] for r in signals.person_signals(rows, "p", "m").collect()} == {"a": 0, "b": 0, "c": 0}


def test_all_eight_categories_from_scored_messages(spark):
    """Dimensions, signals and category from messages alone."""
    banks = scoring.Banks({
        "phrase_banks": {"payment": ["\\bpay(?:ment)?\\b"], "work": ["\\bteacher\\b"], "hurry": ["\\btoday\\b"], "pos": ["\\bgreat\\b"]}, "negativity_patterns": ["\\bscam\\b"], "noise_exact": ["ok"], "buying_categories": ["payment"],
        "dimensions": {"D1_b": {"max": 8, "weights": {"payment": 9}}, "D3_u": {"max": 5, "weights": {"hurry": 3}}, "D4_f": {"max": 10, "weights": {"work": 5}}, "D5_o": {"max": 5, "weights": {}}, "D7_r": {"max": 5, "weights": {"payment": 2}}},
    })
    said = {"high": ["payment link not working today"], "strong": ["what is the price"], "moderate": ["i am a teacher"], "seeking": ["prompts?"], "unclear": ["ok"], "negative": ["this is a scam"], "silent": [], "absent": []}
    rows = spark.createDataFrame([(p, m) for p, ms in said.items() for m in ms], "p string, m string")
    dims = scoring.dimension_scores(rows, "p", "m", banks)
    own = {r["p"]: r for r in dims.collect()}
    assert (own["high"]["D1"], own["high"]["D3"], own["high"]["D7"], own["high"]["intent"], own["moderate"]["D4"], own["negative"]["neg"]) == (8, 3, 2, 1, 5, 1)
    people = spark.createDataFrame([(p, p != "absent", bool(ms), None, None, None, False, False) for p, ms in said.items()], "p string, attended boolean, chatted boolean, pct double, cta boolean, pricing boolean, orphan boolean, no_text boolean")
    people = people.join(dims.drop("pos", "pasted", "pasted_blocked", "cat"), "p", "left").join(signals.person_signals(rows, "p", "m"), "p", "left")
    got = {r["p"]: r["category"] for r in categorize.categorized(people).collect()}
    assert got == dict(zip(said, [categorize.HIGH, categorize.STRONG, categorize.MODERATE, categorize.SEEKING, categorize.UNCLEAR, categorize.NEGATIVE, categorize.SILENT, categorize.ABSENT]))
