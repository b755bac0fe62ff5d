"""Whole sessions with invented people, from files to delivered rows."""

import csv
import io
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from parley.operators import people, scoring, sinks
from parley.plans import session

HEAD = "Attended,User Name (Original Name),First Name,Last Name,Email,Phone,Registration Time,Approval Status,Join Time,Leave Time,Time in Session (minutes),Is Guest,Country/Region Name"
BANKS = scoring.Banks({
    "phrase_banks": {"payment": ["\\bpay(?:ment)?\\b", "\\bfees?\\b"], "joining": ["\\bjoin\\b", "\\benrol"], "work": ["\\bteacher\\b", "\\bengineer\\b"], "pos": ["\\bgreat\\b"]},
    "negativity_patterns": ["\\bwaste of time\\b", "\\buseless\\b"],
    "noise_exact": ["ok", "yes"],
    "buying_categories": ["payment", "joining"],
    "dimensions": {"D1_buying": {"max": 20, "weights": {"payment": 6, "joining": 4}}, "D4_fit": {"max": 10, "weights": {"work": 5}}, "D7_ready": {"max": 5, "weights": {"payment": 5}}},
})


def at(hour, minute):
    return f'"08/09/2026 {(hour - 1) % 12 + 1:02d}:{minute:02d}:00 {"AM" if hour < 12 else "PM"}"'


def person(name, email, phone, join, leave, attended="Yes"):
    first, last = name.split(" ", 1)
    return f"{attended},{name},{first},{last},{email},{phone},{at(9, 0)},approved,{join},{leave},60,No,India"


def report(*rows, minutes=226):
    meta = f"Attendee Report\nReport generated time,08/09/2026 02:31:08 PM\nTopic,Webinar ID,Actual Start Time,Actual Duration (minutes),# Registrants,Unique Viewers,Total Users\nWorkshop,000 0000 0000,{at(10, 45)},{minutes},6,5,6\n"
    host = f"Host Details\nAttended,User Name (Original Name),Email,Join Time,Leave Time,Time in Session (minutes),Is Guest,Country/Region Name\nYes,The Host,host@example.invalid,{at(10, 45)},{at(14, 30)},225,No,India\n"
    return meta + host + "Attendee Details\n" + HEAD + "\n" + "\n".join(rows) + "\n"


SMOKE = report(
    person("Buyer Person", "buyer@example.invalid", "9845344701", at(10, 50), at(14, 29)), person("Asker Person", "asker@example.invalid", "9845344702", at(10, 52), at(14, 0)),
    person("Quiet Person", "quiet@example.invalid", "9845344703", at(10, 55), at(13, 30)), person("Grumpy Person", "grumpy@example.invalid", "9845344704", at(11, 0), at(11, 20)),
    person("Token Person", "token@example.invalid", "9845344705", at(11, 5), at(14, 25)), person("Noshow Person", "noshow@example.invalid", "9845344706", "", "", "No"),
)
TALK = """2026-08-09 10:51:00 From Buyer Person to Everyone:
\tI want to join, please send me the payment link
2026-08-09 10:52:30 From Asker Person to Everyone:
\tI am a school teacher, will this help me make question papers?
2026-08-09 11:06:00 From Token Person to Everyone:
\t10x
2026-08-09 11:07:00 From Token Person to Everyone:
\t10x
2026-08-09 11:08:00 From Token Person to Everyone:
\tbonus
2026-08-09 11:10:00 From Grumpy Person to Everyone:
\tthis is a waste of time, useless
2026-08-09 13:40:00 From Buyer Person to Everyone:
\twhat is the fees and is there an emi option?
"""


def sheets(path):
    """The cells of the workbook's sheets."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        strings = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for name in ("xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"):
            rows = ElementTree.fromstring(z.read(name)).iter(f"{space}row")
            yield [[strings[int(c[0].text)] if c.get("t") == "s" else c[0].text for c in row] for row in rows]


def of_texts(spark, *files, **options):
    table = spark.createDataFrame([(r, k, role, t) for r, k, role, t in files], "room string, file_ord int, role string, text string")
    return session.Session.of_files(table, BANKS, session.Options(**options))


def test_smoke_session_from_a_folder(spark, tmp_path):
    (tmp_path / "attendee.csv").write_text(SMOKE)
    (tmp_path / "chat.txt").write_text(TALK)
    (tmp_path / "copy.txt").write_text(TALK)
    from parley.sources import session as sources

    own = session.Session.of_uploads(sources.uploads(spark, str(tmp_path)), BANKS)
    rows = {r["email"].split("@")[0]: r for r in own.deliver().collect()}
    assert len(rows) == 6
    assert rows["noshow"]["category"] == "non attended" and rows["quiet"]["category"] == "non chatted"
    assert rows["buyer"]["category"] == "purchase intent high" and rows["grumpy"]["category"] == "negative engagement"
    assert rows["token"]["relevant"] == "" and rows["token"]["deleted"] == "10x | bonus"
    assert rows["buyer"]["relevant"].startswith("I want to join") and rows["buyer"]["msg_count"] == 2
    assert (rows["buyer"]["cc"], rows["buyer"]["phone"], rows["buyer"]["minutes"], rows["buyer"]["room"]) == ("+91", "9845344701", 219.0, "root")
    assert own.audit.filter(F.col("kind").isin("bad_chars", "repeats", "vocab_leaks")).isEmpty()
    ordered = [r["category"] for r in own.ordered().collect()]
    assert ordered[0] == "purchase intent high" and ordered[-1] == "non attended"

    sinks.csv_file(own.deliver(), own.audit, str(tmp_path / "leads.csv"), extras=True)
    raw = (tmp_path / "leads.csv").read_bytes()
    table = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    assert raw.startswith(b"\xef\xbb\xbf") and [r["Engagement category"] for r in table] == ordered and table[-1]["Attended?"] == "No"
    sinks.write_xlsx(own.deliver(), own.audit, own.report, str(tmp_path / "leads.xlsx"), extras=True)
    leads, told = sheets(tmp_path / "leads.xlsx")
    assert leads[0][:3] == ["Customer name", "Customer email", "Country code"] and len(leads) == 7 and [r[4] for r in leads[1:]] == ordered
    assert leads[1][3] == "9845344701" and float(leads[1][10]) == 219.0
    assert ["  purchase intent high", "1"] in told and ["Chat-clean audit (must be 0/0/0)", "bad_chars=0 repeats=0 vocab_leaks=0"] in told
    found = json.loads(own.summary.first()["summary"])
    assert found["rows"] == 6 and found["audit"] == {"bad_chars": 0, "repeats": 0, "vocab_leaks": 0} and found["category_counts"]["non attended"] == 1
    assert found["session_date"] == "2026-08-09" and found["attribution"]["msgs_attributed"] == 7 and not found["have_offsets"]
    with pytest.raises(sinks.GateError):
        sinks.write_xlsx(own.results, spark.createDataFrame([("repeats", "x x", 1)], "kind string, value string, n int"), own.report, str(tmp_path / "no.xlsx"))
    assert not (tmp_path / "no.xlsx").exists()
    shown = people.shown(own.results).filter("e = 'token@example.invalid'").first()
    assert (shown["del"], shown["rel"], shown["p"]) == (["10x", "bonus"], [], "+91 9845344705") and people.matching(own.results, "non attended", " NOSHOW ").count() == 1


def test_scripts_survive(spark):
    rows = report(person("Ravi Kumar", "ravik9382@gmail.com", "9845344750", at(10, 50), at(14, 10)), person("Tata Fan", "tatafan1988@gmail.com", "9812345670", at(10, 50), at(14, 10)), minutes=225)
    said = ["क्या यह फ्री है?", "मेरा पैसा रिटर्न कर", "நன்றி", "ధన్యవాదాలు", "میں شامل ہونا چاہتا ہوں"]
    talk = "".join(f"10:5{5 + k if k < 5 else 9}:0{k} From Ravi Kumar to Everyone:\n\t{m}\n" for k, m in enumerate(said))
    talk += "11:00:06 From Tata Fan to Everyone:\n\tTata Motors is my company\n11:01:07 From Tata Fan to Everyone:\n\tPapa is retired and murmur\n"
    own = of_texts(spark, ("root", 1, "attendee", rows), ("root", 1, "chat", talk))
    found = {r["email"]: r for r in own.deliver().collect()}
    assert all(m in found["ravik9382@gmail.com"]["relevant"].split(" | ") for m in said)
    assert found["tatafan1988@gmail.com"]["relevant"] == "Tata Motors is my company | Papa is retired and murmur"


def test_names_rooms_phones_and_pools(spark):
    """A renamed person keeps both names; a namesake who left earlier doesn't get later messages; nobody gets what two may have
    written; a second registration with the same phone shows the chat of the first; absent people are no candidates."""
    one = report(
        person("Sam Roy", "sam1@firm.example", "9845344711", at(11, 0), at(12, 0)), person("Sam Roy", "sam2@firm.example", "9845344712", at(11, 30), at(14, 0)),
        person("Sam Roy", "sam3@firm.example", "9845344713", "", "", "No"), person("Old Name", "ren@firm.example", "9845344714", at(11, 0), at(11, 30)),
        person("New Name", "ren@firm.example", "9845344714", at(11, 40), at(13, 0)), person("Twin Phone", "twin@firm.example", "9845344714", at(11, 0), at(13, 0)),
    )
    two = report(person("Sam Roy", "sam1@firm.example", "", at(11, 0), at(11, 6)), person("Lone One", "abc@gmail.com", "", at(11, 0), at(11, 30)))
    talk = "".join(
        f"{t} From {who} to Everyone:\n\t{m}\n"
        for t, who, m in [
            ("11:10:00", "Sam Roy", "first sam says hello there"), ("11:45:00", "Sam Roy", "which of us wrote this line"), ("13:30:00", "Sam Roy", "second sam is still here"),
            ("11:05:00", "Old Name", "under the old name"), ("12:30:00", "New Name", "under the new name"), ("12:31:00", "Somebody Else", "not in the report"), ("12:32:00", "Host", "welcome"),
        ]
    )
    lost = "10:00:00 From A B to Everyone:\n\thi there\n"
    own = of_texts(spark, ("A", 1, "attendee", one), ("A", 1, "chat", talk), ("B", 1, "attendee", two), ("C", 1, "chat", lost), pricing=60, cta=(180, 200))
    rows = {r["email"]: r for r in own.deliver().collect()}
    assert rows["sam1@firm.example"]["all_chats"] == "first sam says hello there" and rows["sam2@firm.example"]["all_chats"] == "second sam is still here"
    assert rows["sam1@firm.example"]["room"] == "A | B" and rows["sam1@firm.example"]["minutes"] == 66.0
    assert rows["ren@firm.example"]["all_chats"] == rows["twin@firm.example"]["all_chats"] == "under the old name | under the new name"
    assert rows["twin@firm.example"]["msg_count"] == 2 and rows["sam3@firm.example"]["category"] == "non attended"
    assert (rows["sam2@firm.example"]["pricing"], rows["sam2@firm.example"]["cta"], rows["abc@gmail.com"]["pricing"]) == (True, True, False)
    count = own.counters.first()
    assert (count["msg_unique"], count["msg_time_resolved"], count["msg_still_ambiguous"], count["msg_no_csv_row"], count["host_blocks"], count["phone_fallback_rows"]) == (2, 2, 1, 1, 1, 1)
    assert count["msgs_dropped_pct"] == 33.33
    assert {(r["room"], r["code"]) for r in own.warnings.collect()} == {("B", "no_chat"), ("C", "no_report")}
    stats = {r["room"]: r for r in own.room_stats.collect()}
    assert (stats["A"]["people"], stats["A"]["attended"], stats["A"]["chat_blocks"], stats["A"]["chat_span_min"], stats["C"]["lost"]) == (5, 4, 7, 145, True)
    report_lines = {r["label"].strip(): r["value"] for r in own.report.collect()}
    assert report_lines["senders with no attendee-report row"] == "1" and report_lines["Chat-clean audit (must be 0/0/0)"] == "bad_chars=0 repeats=0 vocab_leaks=0"


def test_pool_of_a_silent_namesake(spark):
    rows = report(person("Sam Roy", "sam1@firm.example", "", at(11, 0), at(12, 0)), person("Sam Roy", "sam2@firm.example", "", at(11, 0), at(11, 50)))
    own = of_texts(spark, ("A", 1, "attendee", rows), ("A", 1, "chat", "11:10:00 From Sam Roy to Everyone:\n\twhat is the price\n"))
    found = {r["email"]: r for r in own.deliver().collect()}
    assert found["sam1@firm.example"]["all_chats"] == "[unattributed -- one of 2 same-name registrants in this room] what is the price"
    assert found["sam1@firm.example"]["category"] == "no clear intent" and found["sam1@firm.example"]["chatted"] == "Yes"
    assert found["sam2@firm.example"]["chatted"] == "No" and found["sam2@firm.example"]["category"] == "non chatted"


def test_an_empty_session(spark):
    own = of_texts(spark)
    assert own.results.count() == 0 and own.warnings.count() == 0 and own.counters.count() == 1


@pytest.mark.parametrize("raw, want", [("90", 90.0), (" 1440 ", 1440.0), ("1441", None), ("", None), (None, None), ("x", None), ("-1", None), ("nan", None)])
def test_offsets(raw, want):
    assert session.offset(raw) == want


def test_pools_are_made_for_those_who_are_shown_them(spark):
    rows = report(person("Sam Roy", "sam1@firm.example", "", at(11, 0), at(12, 0)), person("Sam Roy", "sam2@firm.example", "", at(11, 0), at(11, 50)))
    own = of_texts(spark, ("A", 1, "attendee", rows), ("A", 1, "chat", "11:10:00 From Sam Roy to Everyone:\n\twhat is the price\n"))
    assert [(r["gk"], r["pool"], r["n_candidates"]) for r in own.pools.collect()] == [("sam1@firm.example", ["what is the price"], 2)]
