"""Exact duplicates by deterministic block naming, with DataFrame functions only.

White space goes, the rest is cut into blocks of fixed size.  The distinct blocks are sorted, and a block's place is its
integer name; then adjacent names of a document are paired, the distinct pairs sorted and named, and so on until each document
has one name.  Documents have the same number of levels and the same name exactly if their normalised texts are the same: no
hash decides.  A 128-bit digest only routes blocks, so that their text is shuffled once, without the copies within a task,
and not again to bring the names back; that it is injective on the corpus is checked, else another seed is taken.

Each table of names is written to the shared folder, so a lost executor repeats part of one level at most.  Equal blocks
meet as one row for each task; each name says how many rows it is for, and the joins that bring names back broadcast the few
that a thousandth of the rows has (see ``join_counted``), so no hot key meets in one task.

Defined results: null text counts as empty, all empty texts are equal; of repeated rows one stays; a null id is after all
others; an empty table gives an empty table; further columns of the input are ignored by the groups and kept by the dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, drop, join_counted, materialize, numbered

#: Characters of a block.
BLOCK = 4096
ROW = "__parley_row"


def _normal(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS + "+", "")


def _blocks(size: int):
    return F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _digest(block, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(block, F.lit(~seed)).alias("h2"))


def _named(distinct: DataFrame, by: str | list[str], keys: list[str], tag: str) -> DataFrame:
    """The distinct rows' integer names: their places when sorted.  ``n`` is how often each occurs."""
    return materialize(distinct.sortWithinPartitions(by).select(*keys, "n", F.monotonically_increasing_id().alias("name")), tag)


def _level_zero(docs: DataFrame, text_col: str, size: int, seed: int) -> DataFrame | None:
    """Names of the distinct blocks by digest, or None if two blocks share one."""
    block = docs.select(_normal(text_col).alias("norm")).select(F.explode(_blocks(size)).alias("block"))
    found = block.select("block", _digest(F.col("block"), seed).alias("d")).groupBy("d.h1", "d.h2", "block").agg(F.count(F.lit(1)).alias("n"))
    names = _named(found, "block", ["h1", "h2"], "block-names")
    if names.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").isEmpty():
        return names
    drop(names)
    return None


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256 for each row (and ``row_col`` if there is one)."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    seed = 0
    while (names := _level_zero(docs, text_col, block, seed)) is None:
        seed += 1
    text = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), _normal(text_col).alias("norm"))
    base = materialize(text.select("row", "id", "points", F.sha2("norm", 256).alias("sha"), F.transform(_blocks(block), lambda b: _digest(b, seed)).alias("d")), "documents")
    rows, total, most = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("d")), F.lit(0)), F.coalesce(F.max(F.size("d")), F.lit(1))).first()

    parts = base.select("row", F.size("d").alias("k"), F.posexplode("d").alias("at", "d")).select("row", "k", "at", "d.h1", "d.h2")
    parts = join_counted(parts, names, ["h1", "h2"], "n", total).select("row", "k", "at", "name")
    done, spent, level = [], [], 0
    while True:
        # The last level is read by the result; every other one by the next level too.
        parts = materialize(parts, f"level-{level}")
        spent.append(parts)
        done.append(parts.filter("k = 1").select("row", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        half = F.floor(F.col("at") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = parts.filter("k > 1").groupBy("row", ((F.col("k") + 1) / 2).cast("int").alias("k"), half.alias("at")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"))
        pairs = materialize(pairs, f"pairs-{level}")
        spent.append(pairs)
        drop(names)
        names = _named(pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n")), ["l", "r"], ["l", "r"], f"pair-names-{level}")
        parts = join_counted(pairs, names, ["l", "r"], "n", pairs.count()).select("row", "k", "at", "name")
        most, level = (most + 1) // 2, level + 1

    one = done[0]
    for more in done[1:]:
        one = one.unionByName(more)
    own = materialize(base.select("row", "id", "points", "sha").join(one, "row"), "named")
    drop(base, names, *spent)
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    groups = materialize(own.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best), "groups")
    out = join_counted(own.select("row", "id", "sha", "level", "name"), groups, ["level", "name"], "group_size", rows)
    columns = [F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")]
    return out.select(*columns, *([F.col("row").alias(row_col)] if row_col else []))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    own = numbered(docs, ROW)
    kept = exact_groups(own, id_col, text_col, ROW).filter("kept").select(ROW)
    return own.join(kept, ROW, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS k
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
