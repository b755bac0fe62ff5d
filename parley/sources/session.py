"""Uploads as tables: files, archives and compressed files, by what they contain."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chatlog, roster

MEMBERS = "upload_ord long, path string, member string, member_ord int, room string, content binary, note string"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """upload_ord (time of writing), path, content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.unix_micros("modificationTime").alias("upload_ord"), "path", "content")


def members(files: DataFrame) -> DataFrame:
    """upload_ord, path, member, member_ord, room, content, note: each file, or each .csv and .txt member of an archive.

    A compressed file is inflated and loses its ``.gz``; a member's room is the folder it is in, or ``root``; what can't be
    read becomes a note and fails nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pylist([{"upload_ord": k} | row for row in _read(path, content or b"")], pa.schema([("upload_ord", pa.int64()), ("path", pa.string()), ("member", pa.string()), ("member_ord", pa.int32()), ("room", pa.string()), ("content", pa.binary()), ("note", pa.string())]))

    return files.select("upload_ord", "path", "content").mapInArrow(run, MEMBERS)


def _read(path: str, content: bytes) -> Iterator[dict]:
    name = path.rsplit("/", 1)[-1]
    row = {"path": path, "member": name, "member_ord": 0, "room": "root", "content": None, "note": None}
    try:
        if content[:2] == b"\x1f\x8b":
            content, name = gzip.decompress(content), name.removesuffix(".gz")
            row["member"] = name
        if not name.lower().endswith(".zip"):
            yield row | {"content": content}
            return
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (OSError, EOFError, zipfile.BadZipFile) as e:
        yield row | {"note": f"{name}: can't be read ({e})"}
        return
    for k, info in enumerate(archive.infolist()):
        if info.is_dir() or not info.filename.lower().endswith((".csv", ".txt")):
            continue
        folders = info.filename.split("/")[:-1]
        inner = row | {"member": info.filename, "member_ord": k, "room": folders[-1] if folders else "root"}
        try:
            yield inner | {"content": archive.read(info)}
        except (OSError, RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
            yield inner | {"note": f"{info.filename}: can't be read ({e})"}


def without_copies(members: DataFrame) -> DataFrame:
    """The first upload of members with the same bytes; only hashes are compared."""
    order = ["upload_ord", "path", "member_ord"]
    rows = members.filter("content IS NOT NULL").withColumn("hash", F.md5("content"))
    first = rows.groupBy("hash").agg(F.min(F.struct(*order)).alias("f")).select("hash", "f.*")
    return rows.join(first, ["hash", *order], "left_semi").drop("hash")


def sorted_out(members: DataFrame) -> DataFrame:
    """upload_ord, path, member, member_ord, room, text, role: attendee, chat or unusable, by content and not by name."""
    rows = members.withColumn("text", text.decode_bytes(F.col("content"))).drop("content")
    low = F.lower("member")

    def role(content):
        lines = text.lines(content)
        report, chat = low.endswith(".csv") & F.exists(lines, roster.is_header), low.endswith(".txt") & chatlog.looks_like_chat(lines)
        return F.when(report, "attendee").when(chat, "chat").otherwise("unusable")

    # The text is bound, so that it is decoded once.
    return rows.withColumn("role", F.element_at(F.transform(F.array("text"), role), 1))


def rooms(files: DataFrame) -> DataFrame:
    """room, file_ord, role, text of the usable files, numbered by upload within room and role; a room with none is no room."""
    order = Window.partitionBy("room", "role").orderBy("upload_ord", "path", "member_ord")
    return files.filter("role <> 'unusable'").withColumn("file_ord", F.row_number().over(order)).select("room", "file_ord", "role", "text")


def notes(members: DataFrame) -> DataFrame:
    """path, member, note: what was left out of the uploads and why."""
    own = ["upload_ord", "path", "member_ord"]
    whole = members.filter("content IS NOT NULL")
    kept = without_copies(members)
    copies = whole.join(kept.select(*own), own, "left_anti").select("path", "member", F.lit("duplicate copy skipped").alias("note"))
    unread = members.filter("note IS NOT NULL").select("path", "member", "note")
    said = F.when(F.lower("member").endswith(".csv"), "no attendee section: ignored").when(F.lower("member").endswith(".txt"), "no chat headers: ignored")
    unusable = sorted_out(kept).filter("role = 'unusable'").select("path", "member", said.alias("note")).filter("note IS NOT NULL")
    return unread.unionByName(copies).unionByName(unusable)


def paired(reports: DataFrame, chats: DataFrame, order: str = "upload_ord") -> DataFrame:
    """Loose files as rooms: one report takes all chats; as many of both pair by order; no chats are fine.

    Any other numbers are an error.  Adds room to the union of both.
    """
    n, m = reports.count(), chats.count()
    if n != 1 and m not in (0, n):
        raise ValueError(f"{n} reports and {m} chats can't be paired")
    if n == 1:
        return reports.unionByName(chats).withColumn("room", F.lit("Session"))
    # The rows are uploads of one session: a few.
    number = lambda df: df.withColumn("room", F.concat(F.lit("Room "), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)).cast("string")))
    return number(reports).unionByName(number(chats))
