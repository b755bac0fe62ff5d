"""Uploads of every kind, sorted out by content; deliverables and their gate."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from parley.operators import roster, sinks
from parley.sources import session

REPORT = """Attendee Report
Topic,Webinar ID,Actual Start Time,Actual Duration (minutes),# Registrants
Live,1,"08/02/2026 10:50:00 AM",90,x
Host Details,
Attended,User Name (Original Name),Email,Join Time
Yes,Host,host@x.example,"08/02/2026 10:40:00 AM"
Attendee Details,
Attended,User Name (Original Name),First Name,Last Name,Email,Phone,Registration Time,Approval Status,Join Time,Leave Time
Yes,"Asha R",A,R,asha@x.example,919845344750,"08/01/2026 09:00:00 AM",ok,"08/02/2026 10:50:00 AM","08/02/2026 11:20:00 AM"
Yes,"Asha R",A,R,asha@x.example,,"08/01/2026 09:00:00 AM",ok,"08/02/2026 11:10:00 AM","08/02/2026 11:50:00 AM"
Y\x00es,"Ben, K",B,K,ben@x.example,,--,ok,"08/02/2026 10:50:00 AM","08/02/2026 10:55:00 AM"
No,Cleo,C,,cleo@x.example,,--,ok,--,--
Report generated,today
Yes,Late,L,,late@x.example,,--,ok,--,--
"""
CHAT = "23:58:00 From Asha R to Everyone:\n\thello\n00:02:00 From Ben, K to Everyone:\n\tReplying to \"hello\"\n\thi\n\tthere\n"


def test_members_roles_and_rosters(spark, tmp_path):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("Room 1/report.csv", REPORT)
        z.writestr("Room 1/chat.txt", CHAT.encode("utf-16"))
        z.writestr("Room 1/image.png", b"x")
    (tmp_path / "a.zip").write_bytes(archive.getvalue())
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(("﻿" + REPORT).encode()))
    (tmp_path / "c.txt").write_text("nothing here")
    (tmp_path / "d.zip").write_bytes(b"PK broken")
    members = session.members(session.uploads(spark, str(tmp_path)))
    found = {r["member"]: (r["room"], r["role"]) for r in session.sorted_out(members.filter("content IS NOT NULL")).collect()}
    assert found == {"Room 1/report.csv": ("Room 1", "attendee"), "Room 1/chat.txt": ("Room 1", "chat"), "b.csv": ("root", "attendee"), "c.txt": ("root", "unusable")}
    assert members.filter("note IS NOT NULL").count() == 1
    # Four payloads differ byte for byte; of each the upload that came first stays, whatever its path.
    again = members.withColumns({"path": F.concat(F.lit("0"), "path"), "upload_ord": F.col("upload_ord") + 10**12})
    left = session.without_copies(again.unionByName(members))
    assert left.count() == 4 and left.filter(F.col("path").startswith("0")).isEmpty()
    said = sorted((r["member"], r["note"]) for r in session.notes(again.unionByName(members)).filter("note NOT LIKE '%can''t%'").collect())
    assert said == sorted([(m, "duplicate copy skipped") for m in ("Room 1/report.csv", "Room 1/chat.txt", "b.csv", "c.txt")] + [("c.txt", "no chat headers: ignored")])
    assert {(r["room"], r["file_ord"], r["role"]) for r in session.rooms(session.sorted_out(left)).collect()} == {("Room 1", 1, "attendee"), ("Room 1", 1, "chat"), ("root", 1, "attendee")}

    lines = roster.numbered_lines(spark.createDataFrame([("f", REPORT)], "file string, text string"))
    meta = roster.session_meta(lines, ["file"]).collect()
    assert [(m["topic"], m["duration_min"], m["registrants"], str(m["start"])) for m in meta] == [("Live", 90.0, 0, "2026-08-02 10:50:00")]
    people = {r["rec_key"]: r for r in roster.records(roster.typed_rows(roster.attendee_rows(lines, ["file"])), ["file"]).collect()}
    assert set(people) == {"asha@x.example", "ben@x.example", "cleo@x.example"}
    asha = people["asha@x.example"]
    assert (asha["seconds_present"], asha["reconnections"], asha["phone"], asha["pre_registered"]) == (3600, 1, "9845344750", True)
    assert people["ben@x.example"]["name"] == "Ben, K" and not people["cleo@x.example"]["attended_flag"]


def test_cells_beyond_those_parsed_at_a_time_are_read(spark):
    questions = [f'"Question {i}, or ""so"""' for i in range(100)]
    answers = [f'"a{i}, b"' if i % 3 else "" for i in range(100)]
    report = "Attendee Details,\n" + ",".join(["Attended,User Name (Original Name),First Name,Email", *questions, "Join Time,Leave Time,Country/Region Name"]) + "\n"
    report += ",".join(['Yes,"Asha, R",A,asha@x.example', *answers, '"08/02/2026 10:50:00 AM","08/02/2026 11:20:00 AM",India']) + "\n"
    lines = roster.numbered_lines(spark.createDataFrame([("f", report)], "file string, text string"))
    rows = roster.attendee_rows(lines, ["file"])
    cells = rows.first()["cells"]
    assert len(cells) == 107 and all(cells[f'Question {i}, or "so"'] == (f"a{i}, b" if i % 3 else "") for i in range(100))
    person = roster.records(roster.typed_rows(rows), ["file"]).first()
    assert (person["seconds_present"], person["country"], person["name"]) == (1800, "India", "Asha, R")


def test_chat_passes_midnight(spark):
    from parley.operators import chatlog

    lines = roster.numbered_lines(spark.createDataFrame([("f", CHAT)], "file string, text string"))
    a, b = chatlog.blocks(lines, ["file"]).orderBy("block_id").collect()
    assert b["sec"] - a["sec"] == 240 and b["lines"] == ["hi", "there"] and a["sender"] == "Asha R"


def test_gate(spark, tmp_path):
    results = spark.createDataFrame([("A\x01", "a@x", "+91", "98", "moderate", "fees?", "mb | ok")], "name string, email string, cc string, phone string, category string, relevant string, deleted string")
    clean = spark.createDataFrame([("freq_suspects", "x", 50)], "kind string, value string, n int")
    sinks.write_csv(results, clean, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["Customer name"] == "A"
    with pytest.raises(sinks.GateError):
        sinks.write_csv(results, clean.selectExpr("'repeats' AS kind", "value", "n"), str(tmp_path / "no"))
    assert [r["value"] for r in sinks.removed_messages(results).collect()] == ["A\x01 <a@x>: mb", "A\x01 <a@x>: ok"]


def test_blocks_are_numbered_by_pieces_of_a_file(spark, monkeypatch):
    """The numbers of a file's blocks don't depend on how its lines are dealt, and a dated file is in no window as a whole."""
    from parley.operators import chatlog

    monkeypatch.setattr(chatlog, "PIECE", 3)
    talk = [x for k in range(40) for x in (f"2026-08-{2 + k // 20:02d} 10:00:{k:02d} From P{k} to Everyone:", *[f"\tm{k}"] * (k % 4))]
    lines = spark.createDataFrame([("f", 5 * n, x) for n, x in enumerate(["lead", *talk])], "file string, line_no long, line string").repartition(5)
    found = chatlog.untimed(lines, ["file"])
    assert {(r["block_id"], r["sender"], len(r["lines"])) for r in found.collect()} == {(k + 1, f"P{k}", k % 4) for k in range(40)}
    assert {(r["block_id"], r["sec"]) for r in chatlog.blocks(lines, ["file"]).collect()} == {(k + 1, 36_000 + k + 86_400 * (k // 20)) for k in range(40) if k % 4}
