"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids fill whole sequences first; what is left is cut into items of at most ``cut`` ids.  Blocks of items are
partitioned into k windows: each item begins as a partial partition, and the two partial partitions of the largest spread are
merged again and again, largest part of one with smallest of the other, until one partition with near-equal windows is left.
k begins at the least number that could hold the block and rises as long as a window exceeds the capacity.

Blocks are consecutive rows of one input partition, so no shuffle is needed, memory is bounded by a block, and a lost task
makes the same sequences again: sequence ids are the partition's number and a count in it.

Defined results: null and empty text is the end id alone; repeated rows are packed each; an empty table gives an empty table;
further columns of the input are ignored; a text of any length is cut.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import vocabulary
from .common import blocks, documents, give_back, text_list

#: Items that are partitioned together, and ids of an item at most.
BLOCK_ITEMS = 2048
CUT = 512
#: Code points that are encoded together unless asked otherwise, and pieces that a worker holds before they go.
CHUNK_CHARS, HELD = 8_000_000, 2_000
#: Sequences of one input partition are told apart by so many bits.
LOCAL_BITS = 36


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, of each item, with near-equal sums."""
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n + k * n, -1), np.full(2 * n + k * n, -1)
    made = n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, sums, nodes = heappop(heap)
        _, _, other, theirs = heappop(heap)
        over = len(sums) + len(other) - k
        if over <= 0:  # no window need hold two parts yet
            sums, nodes = np.concatenate([sums, other]), np.concatenate([nodes, theirs])
        else:
            # Sorted from large to small: the last ``over`` of each side meet, smallest with largest of these.
            a, b = len(sums) - over, len(other) - over
            new = np.arange(made, made + over)
            made += over
            if made > len(left):
                left, right = np.append(left, np.full(len(left), -1)), np.append(right, np.full(len(right), -1))
            left[new], right[new] = nodes[a:], theirs[b:][::-1]
            sums = np.concatenate([sums[:a], other[:b], sums[a:] + other[b:][::-1]])
            nodes = np.concatenate([nodes[:a], theirs[:b], new])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        least = sums[-1] if len(sums) == k else 0
        heappush(heap, (-int(sums[0] - least), count, sums, nodes))
        count += 1
    window = np.full(made, -1)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(made - 1, n - 1, -1):
        window[left[node]] = window[right[node]] = window[node]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; none holds over ``capacity`` (no item does)."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


class Packer:
    """Gathers items and gives rows: piece columns, sequence number, offset."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.sequences = capacity, [], 0

    def add(self, piece: tuple, length: int) -> list[tuple]:
        if length == self.capacity:
            self.sequences += 1
            return [(*piece, self.sequences - 1, 0)]
        self.items.append((piece, length))
        return self.flush() if len(self.items) >= BLOCK_ITEMS else []

    def flush(self) -> list[tuple]:
        if not self.items:
            return []
        sizes = np.array([n for _, n in self.items], np.int64)
        window = windows(sizes, self.capacity)
        order = np.argsort(window, kind="stable")
        own, size = window[order], sizes[order]
        before = np.cumsum(size) - size
        offset = before - before[np.searchsorted(own, own)]
        rows = [(*self.items[i][0], self.sequences + w, o) for i, w, o in zip(order.tolist(), own.tolist(), offset.tolist())]
        self.sequences += int(window.max()) + 1
        self.items = []
        return rows


@lru_cache(maxsize=4)
def special_string(path: str) -> tuple[str | None, int]:
    """The special string of a vocabulary file and its id."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if len(added) > 1:
        raise ValueError("one special string at most is supported")
    return (added[0]["content"], added[0]["id"]) if added else (None, -1)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, cut: int = CUT, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Pieces of the documents' ids: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    ``path``: a byte-level vocabulary; its ids and then ``end_id`` are a document.  The vocabulary's special string is an id by
    itself wherever it stands.  ``chunk_chars``: code points whose new pre-tokens are encoded together; fewer need less memory
    and more time.
    """
    source = docs.select(id_col, F.col(text_col).alias("__text"))
    key = source.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def pieces(ids: np.ndarray, key, n: int) -> Iterator[tuple[tuple, int]]:
        whole = n // capacity * capacity
        starts = [*range(0, whole, capacity), *range(whole, n, cut)]
        for a, b in zip(starts, [*starts[1:], n]):
            part = ids[a:b]
            yield (key, a, b - a, zlib.crc32(part), n, *([part.copy()] if with_ids else [])), b - a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), TaskContext.get().partitionId() << LOCAL_BITS
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(np.array(cols[-2], np.int64) + base), pa.array(cols[-1], pa.int64())]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        rows: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(0).type
            texts, keys = text_list(batch, "__text"), batch.column(0).to_pylist()
            for a, b in blocks(texts, chunk_chars):
                for c, d, ids, begin in vocabulary(path).encode_parts(texts[a:b], *special_string(path)):
                    # The end id goes in behind each document.
                    ids = np.insert(ids.astype("<u4"), begin[1:], end_id)
                    at = (begin + np.arange(len(begin))).tolist()
                    for key, i, j in zip(keys[a + c : a + d], at, at[1:]):
                        for piece, length in pieces(ids[i:j], key, j - i):
                            rows += packer.add(piece, length)
                        if len(rows) > HELD:
                            yield out(rows)
                            rows = []
        rows += packer.flush()
        if rows:
            yield out(rows)
        give_back()

    return source.mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
