"""Quality rules as a ledger of bits, with DataFrame functions only.

``measure`` reads each whole text once and stores measurements; ``ledger`` evaluates every rule once on these and stores one
bit for each that fails.  A policy is a version and a set of rules: applying one, and counting what each of its rules drops
alone, are bit operations on the stored ledger and never read a text again.  Ablations first count documents by bits, so at
most 2**rules rows leave the aggregation.

Windows of three words are told apart by 64-bit hashes: two different ones of a text of n windows meet with odds of n * n / 2**65
at most (3e-8 for a million).

Defined results: a very long text is measured whole, in one row; null text is a text without words, it fails the base rules; empty lines are not duplicates; repeated rows
are measured each; an empty table gives an empty ledger; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents

WORD_SPLIT = SPACE_CLASS + "+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements."""

    name: str
    fails: str


#: The place of a rule is its bit; new rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        bits = {r.name: 1 << i for i, r in enumerate(RULES)}
        return sum(bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", ("few_words", "repeated_words", "duplicate_lines", "short_words", "long_words", "few_letters")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``.

    Windows are compared by a 64-bit hash.  Most texts have no equal ones and stop there; where few values repeat their
    places are looked up, else windows are sorted with their places.
    """

    def covered(starts: Column) -> Column:
        # Starts are in order; each adds the words up to the next one, three at most.
        steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def looked_up(windows: Column, values: Column) -> Column:
        return F.filter(F.transform(windows, lambda w, i: F.when(F.array_contains(values, w), i)), lambda i: i.isNotNull())

    def sorted_out(placed: Column) -> Column:
        same = lambda x, k: x["w"].eqNullSafe(F.get(placed, k)["w"])
        return F.array_sort(F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def starts(windows: Column) -> Column:
        twice = lambda s: F.array_distinct(F.filter(s, lambda w, k: w.eqNullSafe(F.get(s, k + 1))))
        values = _bind(F.array_sort(windows), twice)
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return _bind(values, lambda v: F.when(F.size(v) <= 16, looked_up(windows, v)).otherwise(_bind(placed, sorted_out)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    window = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_bind(starts(w), covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bind(hashes, lambda h: _bind(window(h), count)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measurements, as long, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def inner(w: Column) -> Column:  # a split leaves an empty string before and after white space at the ends
        lead = (F.element_at(w, 1) == "").cast("int")
        tail = ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("int")
        return F.slice(w, lead + 1, F.size(w) - lead - tail)

    words = _bind(F.split("t", WORD_SPLIT), inner)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    gone = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, "")))
    found = docs.select(F.col(id_col), text.alias("t")).select(
        F.col(id_col),
        _bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r"), F.length(F.array_join(w, "")).alias("c"))).alias("w"),
        gone("[#*$%&|<>]+").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        gone("\\p{L}+").alias("n_letters"),
    )
    values = {"n_words": "w.n", "n_repeat_words": "w.r", "word_chars": "w.c", "n_dup_lines": "l.dup", "n_lines": "l.n"}
    return found.select(F.col(id_col), *(F.col(values.get(m, m)).cast("long").alias(m) for m in MEASURES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``: a bit for each rule."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask())) == 0)


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, rule, n_failed, n_only (failed by this rule of the policy alone), n_dropped and n_documents."""
    counts = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    plan = [F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), F.lit(p.mask()).cast("long").alias("mask"), F.lit(bits[name]).cast("long").alias("bit")) for p in policies for name in p.rules]
    hit = F.col("failed").bitwiseAND(F.col("p.mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return (
        counts.select("failed", "n", F.explode(F.array(*plan)).alias("p"))
        .groupBy(F.col("p.version").alias("version"), F.col("p.rule").alias("rule"))
        .agg(
            total(hit.bitwiseAND(F.col("p.bit")) != 0).alias("n_failed"),
            total(hit == F.col("p.bit")).alias("n_only"),
            total(hit != 0).alias("n_dropped"),
            F.sum("n").alias("n_documents"),
        )
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(apply_policy(ledger(documents(spark, sf_dir)), POLICIES[2]), BASE, "base_kept")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*columns, (~F.col("base_kept")).alias("base_failed"), "kept", F.col("failed").alias("failed_rules"))


OP7_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM x, (SELECT unnest([0, 1, 2]) AS k) WHERE x.n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^\\p{L}]', '', 'g')) AS n_letters, len(lines) AS n_lines
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT + 64 * (100 * n_letters < 50 * word_chars)::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f
"""
