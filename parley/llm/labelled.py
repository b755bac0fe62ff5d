"""A bounded sample of labelled rows to fit a classifier on, and the split that keeps rows held out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no classifier learns from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, label of at most ``rows`` labelled rows that are not held out, the first by a hash of the id.

    The labels are cut to ``rows`` before they meet the documents, so what is broadcast is bounded too.  ``chars``: longer
    texts are left out of the sample, which bounds its bytes.  An id that has several labels counts with the least.
    """
    order = F.xxhash64(F.lit(label), F.col(id_col))
    own = labels.select(id_col, F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(id_col).agg(F.min("label").alias("label")).orderBy(order, id_col).limit(rows)
    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if chars is not None:
        found = found.filter(F.length("text") <= chars)
    return found.join(F.broadcast(own), id_col).select(id_col, "text", "label")


def first_rows(rows: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Repeated ids could make a joined sample longer than its bound."""
    return rows.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(n)


def with_scores(docs: DataFrame, score, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted for each row; ``score`` maps a list of texts to an array."""
    from .common import map_texts

    source = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    found = map_texts(source, [id_col, "held_out"], text_col, "score double", lambda texts: {"score": score(texts)})
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_rows(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows, with all columns, whose texts ``keep`` maps to true."""
    from .common import blocks, give_back, text_list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch, text_col)
            for a, b in blocks(texts):
                yield batch.slice(a, b - a).filter(pa.array(keep(texts[a:b]), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
