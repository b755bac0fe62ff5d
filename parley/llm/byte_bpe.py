"""Byte-level BPE encoding and decoding over a file of merge ranks.

The distinct new pre-tokens of a block lie one after another in one linked list that merges never cross.  The queue of pairs
is by merge rank: one bucket of list positions for each rank in use, and above the buckets three levels of 64-bit words that
say which ones hold something.  Find-first-set in each level gives the next rank; its bucket's live positions are merged at
once, leftmost first where they overlap; entries whose pair has changed since are stale and skipped.  If a merge would make a
pair of the same or a lower rank, that pre-token goes one merge at a time, as the sequential algorithm does.  Queue
operations grow with the bytes, however long a pre-token is.

Defined results: null and empty text have no ids and decode to no bytes; repeated rows are encoded each; an empty table
gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pandas._libs.hashtable import Int64HashTable
from pyspark.sql import DataFrame, SparkSession

from .common import Recent, blocks, documents, map_texts
from .pretokens import Kinds, Split, spread

#: Distinct pre-tokens that a worker remembers, twice at most.
KINDS = 150_000
#: Code points whose new pre-tokens are encoded together.
CHUNK_CHARS = 16_000_000
NO_PAIR = 1 << 30


class RankQueue:
    """Buckets of positions by rank, under a bitmap of three levels."""

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        # Of 16 bits, numpy sorts by radix.
        order = np.argsort(ranks.astype(np.uint16) if len(self.low) <= 1 << 10 else ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        cut = [0, *cut.tolist(), len(ranks)]
        buckets = self.buckets
        for rank, a, b in zip(ranks[cut[:-1]].tolist(), cut, cut[1:]):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [positions[a:b]]
                self.low[rank >> 6] |= 1 << (rank & 63)
                self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                self.top |= 1 << (rank >> 12)
            else:
                bucket.append(positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank in use and its positions in order."""
        top = self.top
        if not top:
            return None
        i = (top & -top).bit_length() - 1
        word = self.mid[i]
        j = i << 6 | (word & -word).bit_length() - 1
        word = self.low[j]
        rank = j << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets.pop(rank)
        self.low[j] &= ~(1 << (rank & 63))
        if not self.low[j]:
            self.mid[i] &= ~(1 << (j & 63))
            if not self.mid[i]:
                self.top &= ~(1 << i)
        if len(bucket) == 1:
            return rank, bucket[0]
        positions = np.sort(np.concatenate(bucket))
        return rank, positions[np.append(True, positions[1:] != positions[:-1])]


class Vocabulary:
    """What merges into what, at which rank.

    pieces: the bytes of each id. pairs: left id, right id, rank, merged id as arrays. whole: pre-tokens that are ids at once.
    """

    def __init__(self, pieces: list[bytes], pairs: tuple[np.ndarray, ...], whole: dict[bytes, int]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.zeros(256, np.int64)
        for i, piece in enumerate(pieces):
            if len(piece) == 1:
                self.byte_ids[piece[0]] = i
        left, right, rank, merged = pairs
        self.pairs = Int64HashTable(len(rank))
        self.pairs.map_locations((left << 32) | right)
        self.rank = np.append(rank, NO_PAIR)  # -1, not found, reads the last
        self.merged = np.zeros(int(rank.max()) + 1, np.int64)
        self.merged[rank] = merged
        # At a plain rank only one pair merges, of different ids, and the result is in pairs of higher ranks only: occurrences
        # never overlap and none makes a pair that would come before the others, so all of them merge at once.
        least = np.full(int(max(left.max(), right.max(), merged.max())) + 1, NO_PAIR)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        plain = (np.bincount(rank) == 1) & (least[self.merged] > np.arange(len(self.merged)))
        plain[rank[left == right]] = False
        self.plain = plain.tolist()
        self.byte_pairs = self.ranks_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.queue = RankQueue(len(self.merged))
        self.whole = whole
        self.known = Recent(KINDS)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of base64 and rank: a pair's rank is that of its bytes, and bytes with a rank are that id."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pieces = [b""] * (max(ranks.values()) + 1)
        pairs = []
        for piece, rank in ranks.items():
            pieces[rank] = piece
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank, rank))
        return cls(pieces, tuple(np.array(pairs, np.int64).T), ranks)

    @classmethod
    def from_merges(cls, path: str) -> Vocabulary:
        """A vocabulary file of ``tokenizers`` with a list of merges, in order of rank."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ids = model["vocab"]
        pieces = [b""] * (max(ids.values()) + 1)
        for piece, i in ids.items():
            if all(c in letters for c in piece):
                pieces[i] = bytes(letters[c] for c in piece)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(merges)]
        return cls(pieces, tuple(np.array(pairs, np.int64).T), {})

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.pairs.lookup((left << 32) | right)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (none is empty), as little-endian uint32."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n, queue = len(raw), self.queue
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        # Position n is a wall that no pair has; one at each pre-token's end keeps the list from running on.
        ids = np.append(self.byte_ids[raw], -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        last = np.zeros(n + 1, bool)
        last[ends - 1] = True
        last[n] = True
        start = np.zeros(n + 1, bool)
        start[ends - lengths] = True
        pending = np.full(n + 1, NO_PAIR)
        live = np.ones(n, bool)
        merged = np.zeros(n, bool)
        i = np.flatnonzero(~last[:n])
        pending[i] = self.byte_pairs[raw[i].astype(np.int64) << 8 | raw[i + 1]]
        i = i[pending[i] < NO_PAIR]
        queue.push(pending[i], i)
        while (entry := queue.pop()) is not None:
            rank, p = entry
            p = p[pending[p] == rank]
            if not len(p):
                continue  # all stale
            made = self.merged[rank]
            if len(p) > 1 and not self.plain[rank]:
                p = self._together(queue, rank, made, p, ids, after, before, last, start, ends)
            j = after[p]
            k = after[j]
            after[p] = k
            before[k] = p
            last[p] = last[j]
            live[j] = False
            pending[j] = NO_PAIR
            ids[p] = made
            left = before[p[~start[p]]]
            merged[p] = True
            touched = np.concatenate([left[~merged[left]], p])
            merged[p] = False
            old = pending[touched]
            new = np.where(last[touched], NO_PAIR, self.ranks_of(ids[touched], ids[after[touched]]))
            pending[touched] = new
            fresh = (new != old) & (new < NO_PAIR) | (new == rank)
            queue.push(new[fresh], touched[fresh])
        out = ids[:n][live].astype("<u4").tobytes()
        ends = (np.cumsum(live)[ends - 1] * 4).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def _together(self, queue, rank, made, p, ids, after, before, last, start, ends) -> np.ndarray:
        """Which of the positions may merge at once; what must wait goes back to the queue."""
        touch = after[p[:-1]] == p[1:]  # overlaps with the next: take every other one of such a chain
        if touch.any():
            head = np.append(True, ~touch)
            at = np.arange(len(p))
            p = p[(at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0]
        k = after[after[p]]
        right = np.where(last[after[p]], NO_PAIR, self.ranks_of(np.full(len(p), made), ids[k]))
        joined = np.append(False, k[:-1] == p[1:])
        left = np.where(start[p], NO_PAIR, self.ranks_of(np.where(joined, made, ids[before[p]]), np.full(len(p), made)))
        low = np.minimum(left, right) <= rank
        if not low.any():
            return p
        of = np.searchsorted(ends, p, "right")
        careful = np.isin(of, np.unique(of[low]))
        first = np.append(True, of[1:] != of[:-1])
        wait = careful & ~first
        queue.push(np.full(int(wait.sum()), rank), p[wait])
        return p[~wait]

    def look_up(self, kinds: list[str]) -> list[bytes]:
        """The ids of each distinct pre-token; one that the vocabulary has whole is its own id."""
        found = self.known.get(kinds)
        at = [i for i, v in enumerate(found) if v is None]
        if at:
            new = [kinds[i] for i in at]
            raw = [k.encode() for k in new]
            whole = [self.whole.get(r) for r in raw]
            rest = iter(self.merge([r for r, w in zip(raw, whole) if w is None]))
            made = [next(rest) if w is None else w.to_bytes(4, "little") for w in whole]
            self.known.put(new, made)
            for i, v in zip(at, made):
                found[i] = v
        return found

    def encode_parts(self, texts: list[str], special: str | None = None, special_id: int = -1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of the texts, their ids, and where each text's begin (and the total).

        The new pre-tokens of all texts are merged together; only one block at a time is split, and spread.
        """
        kinds, parts = Kinds(), []
        for a, b in blocks(texts):
            split = Split(texts[a:b], special)
            parts.append((a, b, kinds.number(split).astype(np.int32), split.doc_first))
            del split
        found = self.look_up(kinds.strings)
        if special in kinds.strings:
            found[kinds.strings.index(special)] = special_id.to_bytes(4, "little")
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        values, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        for a, b, codes, doc_first in parts:
            ids, begin = spread(values, first, size, codes)
            yield a, b, ids, begin[doc_first]

    def encode_block(self, texts: list[str], special: str | None = None, special_id: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (and the total)."""
        ids, begin = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for _, _, part, at in self.encode_parts(texts, special, special_id):
            ids.append(part)
            begin.append(begin[-1][-1] + at[1:])
        return np.concatenate(ids), np.concatenate(begin)

    def decode_block(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out: list[bytes] = []
        n, step = len(begin) - 1, 2_000_000
        cut = np.searchsorted(begin[:-1], np.arange(step, int(begin[-1]) + 1, step)).tolist()
        for a, b in zip([0, *cut], [*cut, n]):
            if a < b:
                raw, at = spread(self.bytes, self.first, self.size, ids[begin[a] : begin[b]])
                raw, at = raw.tobytes(), at[begin[a : b + 1] - begin[a]].tolist()
                out += [raw[i:j] for i, j in zip(at, at[1:])]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_merges(path) if path.endswith(".json") else Vocabulary.from_ranks(path)


@lru_cache(maxsize=1)
def _decimals() -> list[str]:
    return []


def decimal_ids(ids: np.ndarray) -> str:
    """The ids as decimal numbers, joined by commas."""
    table = _decimals()
    if len(ids) and len(table) <= (most := int(ids.max())):
        table.extend(map(str, range(len(table), most + 1)))
    return ",".join(map(table.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ids array<int> of every row of ``docs``; ``path``: a file of ranks."""
    import pyarrow as pa

    def make(texts: list[str]) -> dict:
        ids, begin = vocabulary(path).encode_block(texts)
        return {"ids": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))}

    return map_texts(docs, [id_col], text_col, "ids array<int>", make, CHUNK_CHARS)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and decoded binary of every row; null ids decode to no bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
            raw = vocabulary(path).decode_block(np.concatenate([np.zeros(0, np.int64), *ids]), begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "decoded"])

    source = encoded.select(id_col, ids_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, decoded binary")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and hash of every text's ids, and hash of what they decode to, in one pass."""

    def make(texts: list[str]) -> dict:
        vocab = vocabulary(path)
        ids, begin = vocab.encode_block(texts)
        at = begin.tolist()
        return {
            "n_tokens": np.diff(begin),
            "ids_sha256": [hashlib.sha256(decimal_ids(ids[a:b]).encode()).hexdigest() for a, b in zip(at, at[1:])],
            "decoded_sha256": [hashlib.sha256(raw).hexdigest() for raw in vocab.decode_block(ids, begin)],
        }

    return map_texts(docs, [id_col], text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, CHUNK_CHARS)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
