"""Known answers of the column functions."""

from pyspark.sql import functions as F

from parley.functions import contact, text
from parley.operators import cleaner, scoring


def answers(spark, f, pairs):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = {r[0]: r[1] for r in rows.select("i", f(F.col("a"))).collect()}
    bad = [(a, got[i], want) for i, (a, want) in enumerate(pairs) if got[i] != want]
    assert not bad


def test_clean_message(spark):
    pairs = [
        ("readyyyyyy", "ready"), ("WWWOOWWWWWW", "WOOW"), ("Realllyyyy", "Realy"), ("MBBBBBB", "MB"), ("yess", "yess"),
        ("freshers??", "freshers?"), ("Great!!!", "Great!"), ("1000xx", "1000xx"), ("ready....", "ready...."), ("Any  configuration", "Any configuration"),
        ("-Are you making us pay", "Are you making us pay"), ("Yes yes yes yes yes", "Yes"), ("very very good", "very very good"), ("?", "?"), ("??", ""), (":)", ""), ("\U0001f44d", ""),
        ("Boom Boom", "Boom"), ("its magic its magic", "its magic"), ("MEMEMEMEMEME", "ME"), ("10000x already10000x already", "10000x already"),
        ("10 x 10 X 10 x", "10 x"), ("10X 10 X 10X", "10X"), ("MB MB MB MBMB MBMB MBMB", "MB"), ("skipSkip", "skip"), ("Skip skip skipSkip skip skipSkip skip", "Skip"),
        ("2020", "2020"), ("haha", "ha"), ("it's 2'O clock ⌚", "it's 2'O clock"), ("zero​width", "zerowidth"),
        ("क्या यह फ्री है?", "क्या यह फ्री है?"), ("நன்றி", "நன்றி"), ("価格は?", "価格は?"), ("₹", ""), ("---", ""), ("«»", ""),
        ("Tata Motors", "Tata Motors"), ("Papa is retired", "Papa is retired"), ("murmur", "murmur"), ("GAMESGAMES", "GAMES"), ("price‮is high", "priceis high"), (None, ""), ("", ""),
    ]
    answers(spark, cleaner.clean_message, pairs)


def test_clean_message_is_idempotent(spark):
    raw = ["ha ha ha ha!!", "abcabc abcabc", "x" * 500, "so sooo sooo soooo good good good", "10x 10x 100x100x"]
    rows = spark.createDataFrame([(r,) for r in raw], "a string").select(cleaner.clean_message(F.col("a")).alias("b"))
    assert rows.filter(cleaner.clean_message(F.col("b")) != F.col("b")).isEmpty()


def test_relevance(spark):
    yes = ["?", "ca", "up", "1cr", "nse", "loved it", "payment link not working", "43, Banker", "30 min", "2 hrs", "What are the dates", "mind blowing", "hyderabad", "18 student", "paid", "apple stock is best"]
    no = ["20", "10/10", "100%", "965 3721 5349", "ok", "crm", "hindi", "crazy", "thank you", "3hrs", "1 hr", "90 Days", "days", "mind blown", "tata", "yes sir", "blueprint", "bonus", "apple", "more", "1 day", "2 days"]
    answers(spark, cleaner.is_relevant, [(m, True) for m in yes] + [(m, False) for m in no])


def test_process_messages(spark):
    full = "you told in the video that you will share a free website that can generate free clips, that is why i joined"
    cells = {"a": ["mb", "MB", "MB", "bonus"], "b": ["i have paid", "can you tell me the duration", "31", "clear", "me"], "c": ["\U0001f44d"], "d": [full, full[:80] + "...[truncated]"], "e": ["ai tool for trading", "ai tools for trading"]}
    rows = [(k, i, m) for k, v in cells.items() for i, m in enumerate(v)]
    out = cleaner.process_messages(spark.createDataFrame(rows, "p string, i int, m string"), "p", "i", "m")
    got = {r["p"]: (r["relevant"], r["deleted"], r["dup_removed"], r["lowvol"]) for r in out.collect()}
    assert got["a"] == ("", "mb | bonus", 2, 4)
    assert got["b"] == ("i have paid | can you tell me the duration", "31 | clear | me", 0, 5)
    assert got["c"] == ("", "", 0, 0)
    assert got["d"] == (full, "", 1, 2)
    assert got["e"] == ("ai tools for trading", "", 1, 2)


def test_audit(spark):
    cells = spark.createDataFrame([("payment not working | i have paid",), ("mb | what is the price",), ("again Boom again Boom",)], "relevant string")
    assert {(r["kind"], r["value"]) for r in cleaner.audit(cells).collect()} == {("vocab_leaks", "mb"), ("repeats", "again Boom again Boom")}


def test_emails(spark):
    answers(spark, contact.canon_email, [("A@Gamil.con", "a@gmail.com"), ("x y@yahoo.in.", "xy@yahoo.in"), ("abc@gmail", ""), ("no", ""), (None, ""), ("@x.com", ""), ("a@b@hotmial.com", "a@b@hotmail.com"), ("rahul⁠k@gmail.com", "rahulk@gmail.com")])
    answers(spark, contact.key_email, [("a.b.c@gmail.com", ""), ("Ra.hul+x@gmail.com", "rahul@gmail.com"), ("abc@protonmail.com", ""), ("info@firm.example", "info@firm.example"), ("x@yopmail.com", "")])


def test_phones(spark):
    answers(spark, contact.digits, [("9.18149E+11", ""), ("919845344750.4", ""), ("918149000000.0", ""), ("9845344750.0", "9845344750"), ("+91 98-45", "919845"), (None, "")])
    answers(spark, contact.norm_phone, [("919845344750", "9845344750"), ("9191919845344750", "9845344750"), ("09845344750", "9845344750"), ("07400232640", "7400232640"), ("006582399770", "006582399770"), ("91167084418", "91167084418"), ("9800000000", ""), ("1234567890", ""), ("123456", ""), ("00919845344750", "9845344750")])
    answers(spark, contact.phone_in_email, [("v9177554973@x.com", "9177554973"), ("919876543219@gmail.com", "9876543219"), ("inv98765432101234@x.com", None), ("x", None)])
    split = lambda c: F.concat_ws("/", contact.cc_split(F.lit("United Arab Emirates"), c)["cc"], contact.cc_split(F.lit("United Arab Emirates"), c)["national"])
    answers(spark, split, [("971501234567", "+971/501234567"), ("919845344750", "+91/9845344750"), ("1234567", "+971/1234567"), ("123456", "/123456"), ("", "/"), ("+4412345", "+44/12345")])


def test_times_and_names(spark):
    answers(spark, lambda c: text.parse_timestamp(c).cast("string"), [("08/02/2026 10:50:00 AM", "2026-08-02 10:50:00"), ("8/2/2026 22:05", "2026-08-02 22:05:00"), ("2026-08-02 01:02:03", "2026-08-02 01:02:03"), ("--", None), ("x", None)])
    answers(spark, text.clean_display_name, [("2505445126_ mary-jane o'neil", "Mary-Jane O'Neil"), ("123", "123"), (None, "")])
    answers(spark, lambda c: text.norm_name(text.nfkc(c)), [("  Ａnna--Bell ", "anna bell"), ("हिन्दी", "ह न द"), (None, "")])


def test_banks(spark):
    config = {
        "phrase_banks": {"pricing": ["\\bfees?\\b"], "pos": ["great"]},
        "negativity_patterns": ["waste"],
        "noise_exact": ["hi all"],
        "buying_categories": ["pricing"],
        "dimensions": {"D1_buying": {"weights": {"pricing": 9}, "max": 25}},
    }
    rows = [("a", "what is the fees"), ("a", "great waste of time"), ("a", "fees 10d ago"), ("a", "hi all"), ("b", "great stuff"), ("b", ""), ("c", None)]
    out = {r["p"]: r for r in scoring.dimension_scores(spark.createDataFrame(rows, "p string, m string"), "p", "m", scoring.Banks(config)).collect()}
    assert [out["a"][c] for c in ("D1", "mean", "intent", "neg", "pos", "pasted", "pasted_blocked")] == [9, 3, 1, 1, 0, 1, 1]
    assert out["b"]["pos"] == 1 and out["b"]["D1"] == 0 and "c" not in out
    try:
        scoring.Banks(config | {"negativity_patterns": [" "]})
        raise AssertionError("a blank pattern must be refused")
    except ValueError as e:
        assert "negativity_patterns" in str(e)


def test_near_duplicates_of_few_and_of_many(spark, monkeypatch):
    """Each with each in Python and by rare runs of characters: the same messages stay; a repeated one is cleaned once."""
    import random

    rnd = random.Random(5)
    stem = ["please tell me the duration of the course", "when will the recording be shared with all of us today", "price of it", "is it live", "abcdef", "what is the price of the program and is there an emi option"]
    change = lambda m: "".join(c for c in m if rnd.random() > 0.03) + rnd.choice(["", "", "", "s", " and more than that", " [truncated]"])
    said = [(p, k, change(rnd.choice(stem))) for p in range(12) for k in range(40)]
    rows = spark.createDataFrame(said, "p int, k int, m string").repartition(3)
    tables = []
    kept = lambda df, tag: tables.append(df.localCheckpoint()) or tables[-1]
    run = lambda: sorted(map(tuple, cleaner.process_messages(rows, "p", "k", "m", keep=kept).collect()))
    few = run()
    monkeypatch.setattr(cleaner, "FEW", 0)
    assert few == run() and sum(r[3] for r in few) == len(said) and sum(r[5] for r in few) > 100
    repeated = spark.range(1000).selectExpr("1 AS p", "id AS k", "'go on go on' AS m")
    assert cleaner.process_messages(repeated, "p", "k", "m", keep=kept).first()["raw"] == 1000 and tables[-1].count() == 1
