"""Helpers shared by the corpus operators: reading, row ids, joins without hot keys, bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop, materialize, shared_folder

__all__ = ["drop", "materialize", "shared_folder"]

#: Code points that one block of a vectorised operator holds; a longer text is a block by itself.
BLOCK_CHARS = 2_000_000

#: A key is hot if more than one in so many rows have it.
HOT = 1000

#: The white space that all word contracts use, as a character class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns the operators need, so the scan reads nothing else."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """The rows with an id each, the same at every reading.

    The rows of Parquet files are known by file (128 bits of its path's hash) and place in it, so nothing is written; others
    are written once with a number.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation"):
        path = F.col("_metadata.file_path")
        place = F.struct(F.xxhash64(path).alias("f"), F.xxhash64(F.reverse(path)).alias("g"), F.col("_metadata.row_index").alias("i"))
        try:
            return docs.select("*", place.alias(column))
        except AnalysisException:
            pass
    return materialize(docs.withColumn(column, F.monotonically_increasing_id()), "rows")


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and in ``count`` the number of rows that have it.

    Keys that more than a ``1 / HOT`` of the ``total`` rows have are fewer than ``HOT``: they are broadcast, so that their rows
    stay where they are, and no task of the plain join for the rest has more than that share of one key.
    """
    hot = table.filter(F.col(count) > total // HOT)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(table.filter(F.col(count) <= total // HOT), keys))


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts, each of at most ``limit`` code points or one text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_list(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_texts(df: DataFrame, keep: list[str], text: str, columns: str, make: Callable[[list[str]], dict], limit: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns as they are, then what ``make`` returns for each block of texts.

    ``columns`` is the DDL of the added columns; ``make`` maps a list of texts to arrays by column name.
    Row order and row count stay; memory is bounded by the Arrow batch and by ``limit`` code points.
    """
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch, "__text")
            rest = batch.select(keep)
            for a, b in blocks(texts, limit):
                made = make(texts[a:b])
                part = rest.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v) for v in made.values())], names=[*keep, *made])
        give_back()

    return source.mapInArrow(run, schema)


def give_back() -> None:
    """Returns to the system what a worker's task has freed: workers live on, and their peaks would add up over the stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is another one
    if trim is not None:
        trim(0)


class Recent:
    """Values by key: the last ``size`` keys put, and as many before them."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def get(self, keys: list) -> list:
        found = list(map(self.now.get, keys))
        if self.old:
            for i, v in enumerate(found):
                if v is None and (v := self.old.get(keys[i])) is not None:
                    found[i] = self.now[keys[i]] = v
        return found

    def put(self, keys: list, values: list) -> None:
        if len(self.now) + len(keys) > self.size:
            self.now, self.old = {}, self.now
        self.now.update(zip(keys, values))
