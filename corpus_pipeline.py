"""A corpus pipeline of five stages: quality, exact duplicates, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of documents, with their decisions done: rejected rows are gone, personal data is
replaced.  The last returns one row for each piece of a packed sequence.

Defined results are those of the operators; n_chars follows the text where personal data was replaced and is null where the
text is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import exact_dedup, near_dup, packing, pii, quality_model
from parley.llm.common import drop, materialize, read_table

#: Code points whose pre-tokens packing encodes together, few since the executors hold the stages before too.
PACK_CHARS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_model.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised texts."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets connect."""
    return near_dup.near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, chunk_chars=PACK_CHARS)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal_data), ("packing", pack)]
#: SQL can't express the fitted classifier nor the tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
