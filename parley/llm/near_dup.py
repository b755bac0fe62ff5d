"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles, hashed to 64 bits.  Documents with one set are a class, and classes are joined:

* Sketch.  Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the symmetric
  difference of the sets.  The sketch has a bit for each 64-bit hash, nothing cancels, and it is cut into parts by hash range;
  a part's bits are known by the XOR of its hashes.
* Bands.  Sizes go into bands of ratio 1 / similarity, so a class can only link to its own band and the next.  A band's
  scheme says how many parts there are; classes of the band and of the next one use it.
* Pigeonhole.  A link's symmetric difference is at most d, a share of the sizes, so at most d parts differ.  If a class has
  more than d non-empty parts it must agree in one of any d + 1 of them, taken in one common order: parts made of shingles
  that are common in a sample come last, parts with many shingles come first.  A class with d or fewer emits all its parts and
  the empty ones too.  Both rules lose no link; the sample only orders.
* Verify.  Classes that meet in a part are first compared with one centre for each part, the links give components, and only
  pairs of different components that still meet are compared after that, unless the Hamming distance of short sketches is
  already too large.  Pairs within a component are never made, so a group of thousands of copies costs a few pairs for each.

Nothing but the sample's common shingles (bounded) goes to the driver.  Tables are written to the shared folder.

Defined results: null, empty and wordless texts have an empty set and link with nothing; repeated rows are one class; with
fewer words than a shingle has, the whole sequence is the one shingle; a null id is no component's least; an empty table
gives an empty table; further columns of the input are ignored by the join and kept by the dedup.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, drop, give_back, join_counted, map_texts, materialize, numbered, text_list
from .components import components
from .exact_dedup import ROW
from .pretokens import powers

WORDS, PERCENT = 5, 80
#: Documents in the sample that orders parts, shingles of such a document at most, documents that make a shingle common in
#: it, and common shingles kept at most.
SAMPLE, SAMPLE_SIZE, COMMON, COMMON_MOST = 4096, 20_000, 4, 200_000
#: Parts of a scheme for each shingle of its largest class, and at least.
PARTS, LEAST_PARTS = 0.45, 8
#: 64-bit words of the short sketch of a whole set.
SKETCH_WORDS = 8
#: Rows on a side of a square of rows that are compared with each other.
SQUARE = 1024
#: Clashes of 64-bit names that workers are told of; so many come at 6e11 classes.
CLASHES = 10_000
BLOCK = 1_000_000
SEEN = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUES = np.random.default_rng(90210).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = [int(x) | 1 for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(data)
    at = np.cumsum([0, *map(len, raw)])
    white = _WHITE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = white[:-1] if n else False
    edge[at] = True
    starts = np.flatnonzero(edge[:n] & ~white)
    edge[:n] = white
    edge[at] = True
    stops = np.flatnonzero(edge)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    up, down = powers(max(21, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    m = max(len(word) - words + 1, 0)
    every = np.zeros(m, np.uint64)
    for j in range(words if m else 0):
        every += word[j : j + m] * np.uint64(_PLACES[j])
    every = mix(every)
    sets = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            short = (word[a:b] * np.array(_PLACES[32 : 32 + b - a], np.uint64)).sum(keepdims=True) + np.uint64(b - a)
            sets.append(mix(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs that name each set: 128 bits of its hash."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


@lru_cache(maxsize=4)
def bands(percent: int, upto: int) -> np.ndarray:
    """The largest size of each band."""
    tops, top = [], 1
    while not tops or tops[-1] < upto:
        tops.append(top)
        top = max(top + 1, 100 * top // percent)
    return np.array(tops)


def emitted(own: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys under which a class with this set is found, as uint64."""
    size = len(own)
    limit = 1 << max(12, size.bit_length() + 1)
    tops = bands(percent, limit)
    band = int(np.searchsorted(tops, size))
    keys = []
    hot = None
    for k in (band, band - 1):
        if k < 0:
            continue
        top = int(tops[k])
        if k == band:
            other = 100 * size // percent
        elif 100 * top >= percent * size:
            other = top
        else:
            continue
        # |A ^ B| <= (|A| + |B|) (100 - percent) / (100 + percent)
        d = (size + other) * (100 - percent) // (100 + percent)
        if d < 1:
            continue
        parts = max(LEAST_PARTS, int(np.ceil(PARTS * top)))
        part = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        value = np.bitwise_xor.reduceat(own, begin)
        of = part[begin]
        if len(begin) > d:
            if hot is None:
                hot = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(size, bool)
            count = np.diff(np.append(begin, size))
            late = np.add.reduceat(hot.astype(np.int64), begin) == count
            order = (late.astype(np.uint64) << np.uint64(63)) | ((np.uint64(63) - np.minimum(count, 62).astype(np.uint64)) << np.uint64(57)) | (mix(value) >> np.uint64(7))
            pick = np.argpartition(order, d)[: d + 1]
            value, of = value[pick], of[pick]
        else:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), of)
            value, of = np.concatenate([value, np.zeros(len(empty), np.uint64)]), np.concatenate([of, empty])
        keys.append(mix(value ^ mix(of + np.uint64(k << 40))))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def short_sketches(sets: list[np.ndarray]) -> pa.Array:
    """For each set SKETCH_WORDS longs: each hash flips one bit of them."""
    size = 64 * SKETCH_WORDS
    bits = [np.bincount((s.view(np.uint64) >> np.uint64(7)).astype(np.int64) % size, minlength=size) & 1 for s in sets]
    packed = np.packbits(np.array(bits, np.uint8).reshape(len(sets), size), axis=1).view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), SKETCH_WORDS).cast(pa.list_(pa.int64()))


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int, keep: list[str]) -> DataFrame:
    """n_shingles and the set's name (f1, f2) of each row."""

    def make(texts: list[str]) -> dict:
        sets = shingle_sets(texts, words)
        names = set_names(sets)
        return {"n_shingles": np.fromiter(map(len, sets), np.int64, len(sets)), "f1": names[:, 0], "f2": names[:, 1]}

    return map_texts(docs, [id_col, *keep], text_col, "n_shingles long, f1 long, f2 long", make, BLOCK)


def _of_sample(docs: DataFrame, own: DataFrame, text_col: str, words: int, columns: str, make: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """A column of longs that ``make`` gives for the sets of the rows that ``own`` names."""
    rows = docs.select(ROW, F.col(text_col).alias("text")).join(F.broadcast(own), ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch)
            for a, b in blocks(texts, BLOCK):
                made = make([s for s in shingle_sets(texts[a:b], words) if 0 < len(s) <= SAMPLE_SIZE])
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], names=[columns.split()[0]])
        give_back()

    return rows.select("text").mapInArrow(run, columns)


def _frequent(values: DataFrame, column: str, most: int) -> np.ndarray:
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), column).limit(most).select(column).toArrow().column(column).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def sampled(docs: DataFrame, classes: DataFrame, text_col: str, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, and keys, that several classes in a bounded sample of them have."""
    own = materialize(classes.filter(F.col("n_shingles") <= SAMPLE_SIZE).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(ROW), "sample")
    none = [np.zeros(0, np.uint64)]
    common = _frequent(_of_sample(docs, own, text_col, words, "s long", lambda sets: np.concatenate(none + sets)), "s", COMMON_MOST)
    hot = _frequent(_of_sample(docs, own, text_col, words, "k long", lambda sets: np.concatenate(none + [np.unique(emitted(s, common, percent)) for s in sets])), "k", COMMON_MOST)
    drop(own)
    return common, hot


def part_keys(docs: DataFrame, text_col: str, words: int, percent: int, common: np.ndarray, clashing: frozenset, hot: np.ndarray) -> DataFrame:
    """key, id, salt of every class's emitted parts; copies within a task emit once.

    Rows of one key have one salt, unless it is ``hot``: those are dealt by id.  The salt is made here since a second function
    over Arrow in the same stage would be a second Python worker for each task, and its memory stays with the executor.
    """
    known = pa.array(hot.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = text_list(batch, "__text")
            for a, b in blocks(texts, BLOCK):
                sets = shingle_sets(texts[a:b], words)
                keys, ids = [], []
                for own, (f1, f2) in zip(sets, set_names(sets).tolist()):
                    name = f2 if f1 in clashing else f1
                    if name in seen or not len(own):
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    made = emitted(own, common, percent)
                    keys.append(made)
                    ids.append(np.full(len(made), name, np.int64))
                if keys:
                    key, ident = pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))
                    salt = pc.if_else(pc.is_in(key, known), ident, pa.scalar(0, pa.int64()))
                    yield pa.RecordBatch.from_arrays([key, ident, salt], names=["key", "id", "salt"])
        give_back()

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "key long, id long, salt long")


def meeting(keys: DataFrame, hot: np.ndarray) -> DataFrame:
    """The rows whose key some other id has, without repeats: one shuffle, one sort, and a look at the neighbours.

    ``hot`` keys are known to have several ids, so all their rows stay and need not be neighbours: their salt deals them by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of one key are consecutive, sorted by id.  The last row waits for the next batch.
        key, ident = np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = None  # the key of the row ahead of those at hand
        stays = hot.view(np.int64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            ident = np.concatenate([ident, batch.column(1).to_numpy()])
            new = np.append(True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]))
            key, ident = key[new], ident[new]
            if len(key) > 1:
                same = key[1:] == key[:-1]
                keep = (np.append(key[0] == before, same[:-1]) | same) | np.isin(key[:-1], stays)
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(ident[:-1][keep])], names=["key", "id"])
                before, key, ident = key[-2], key[-1:], ident[-1:]
        if len(key) and (key[0] == before or np.isin(key[0], stays)):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ident)], names=["key", "id"])
        give_back()

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(n, "key", "salt").sortWithinPartitions("key", "id")
    return dealt.select("key", "id").mapInArrow(run, "key long, id long")


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """id, n, s (the set) and sketch of the wanted classes, read from one row of each."""
    own = classes.join(wanted, "id", "left_semi").select("id", ROW)
    rows = docs.select(ROW, F.col(text_col).alias("text")).join(own, ROW).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch)
            for a, b in blocks(texts, BLOCK):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], words)]
                size = np.fromiter(map(len, sets), np.int32, len(sets))
                values = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(size, dtype=np.int32))), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), values, short_sketches(sets)], names=["id", "n", "s", "sketch"])
        give_back()

    return rows.mapInArrow(run, "id long, n int, s array<long>, sketch array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, c) with ``linked``.

    Pairs whose sketches rule a link out are told without their sets; the set of c is read only for ids that are some c.
    """
    short = sets.select("id", "n", "sketch")
    known = pairs.join(short.toDF("id", "n1", "k1"), "id").join(short.toDF("c", "n2", "k2"), "c")
    known = materialize(known.select("id", "c", _may_link("n1", "k1", "n2", "k2", percent).alias("may")), "may-link")
    may = known.filter("may").select("id", "c")
    left = sets.select("id", F.col("n").alias("n1"), F.col("s").alias("s1"))
    right = sets.select(F.col("id").alias("c"), F.col("n").alias("n2"), F.col("s").alias("s2")).join(may.select("c").distinct(), "c", "left_semi")
    rows = may.join(left, "id").join(right, "c").select("id", "c", "n1", "n2", F.size(F.array_intersect("s1", "s2")).alias("i"))
    linked = 100 * F.col("i") >= percent * (F.col("n1") + F.col("n2") - F.col("i"))
    return rows.select("id", "c", linked.alias("linked")).unionByName(known.filter("NOT may").select("id", "c", F.lit(False).alias("linked")))


def _may_link(n1: str, k1: str, n2: str, k2: str, percent: int) -> Column:
    """Sets that link differ by (|A| + |B|) (100 - percent) / (100 + percent) at most, and the Hamming distance of their short
    sketches is no more than that."""
    differ = [F.bit_count(F.get(k1, F.lit(i)).bitwiseXOR(F.get(k2, F.lit(i)))) for i in range(SKETCH_WORDS)]
    near = sum(differ[1:], differ[0]) * (100 + percent) <= (F.col(n1) + F.col(n2)) * (100 - percent)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & near


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))


def _nearest(rows: DataFrame) -> DataFrame:
    """id, c: of the centres that an id meets the one that it meets most often."""
    met = rows.groupBy("id", "c").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("id").agg(F.max_by("c", F.struct("n", "c")).alias("c"))


def _weighed(met: DataFrame, total: int) -> DataFrame:
    """key, id, weight (how many rows an id meets over all its keys, most for what a group was copied from)."""
    size = materialize(met.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key-sizes")
    weight = join_counted(met, size, ["key"], "size", total).groupBy("id").agg(F.sum("size").alias("weight"))
    rows = materialize(met.join(weight, "id").select("key", "id", "weight"), "weighed")
    drop(size)
    return rows


def _with_centres(rows: DataFrame, total: int, *also: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with c, their key's heaviest id; and the table of the keys' centres."""
    heaviest = F.struct("weight", "id")
    centre = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max_by("id", heaviest).alias("c"), *(F.max_by(x, heaviest).alias("of") for x in also)), "centres")
    return join_counted(rows, centre, ["key"], "size", total), centre


def _unsettled(met: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """key, id, weight, root, rows (of the key) of the rows whose key holds several components."""
    own = materialize(met.join(roots.select("id", "root"), "id", "left").select("key", "id", "weight", F.coalesce("root", "id").alias("root")), "rooted")
    per_key = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"))
    open_keys = materialize(per_key.filter("low <> high").select("key", "rows"), "open-keys")
    rows = materialize(join_counted(own, open_keys, ["key"], "rows", total), "unsettled")
    drop(own, open_keys)
    return rows


def _possible(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """id, c: the pairs of different components that meet and whose sketches allow a link.

    A key's rows are dealt into squares of at most SQUARE rows a side, so that no task compares all rows of a frequent key;
    what only resembles a large group falls within the join, before a row is made.
    """
    own = rows.join(sketches, "id").withColumn("sides", F.ceil(F.col("rows") / SQUARE).cast("int"))
    own = own.withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    other = F.sequence(F.lit(0), F.col("sides") - 1)
    dealt = own.select("key", "id", "root", "n", "sketch", "side", F.explode(other).alias("other"))
    dealt = materialize(dealt.select("key", "id", "root", "n", "sketch", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")), "squares")
    a, b = dealt.alias("a"), dealt.alias("b")
    # Within a square of two sides each pair has a row of either; on the diagonal the lesser id goes first.
    first = (F.col("a.side") < F.col("b.side")) | ((F.col("a.low") == F.col("a.high")) & (F.col("a.id") < F.col("b.id")))
    same = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("key", "low", "high")]
    on = same[0] & same[1] & same[2] & first & (F.col("a.root") != F.col("b.root")) & _may_link("a.n", "a.sketch", "b.n", "b.sketch", percent)
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("c")).distinct()


def class_roots(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, root of the classes that link with another."""
    found, roots, centre, spent = None, None, None, []
    total = met.count()
    met = _weighed(met, total)
    spent.append(met)
    for step in ("nearest", "centre", "all"):
        if step == "nearest":
            pairs, centre = _with_centres(met, total)
            pairs = _nearest(pairs.filter("id <> c"))
        else:
            rows = _unsettled(met, roots, total)
            spent.append(rows)
            if rows.isEmpty():
                break
            if step == "centre":
                pairs, centre = _with_centres(rows, total, F.col("root"))
                pairs = _nearest(pairs.filter("root <> of"))
            else:
                pairs, centre = _possible(rows, sets.select("id", "n", "sketch"), percent), None
            tried = _ordered(found).distinct()
            pairs = pairs.withColumns({"a": F.least("id", "c"), "b": F.greatest("id", "c")}).join(tried, ["a", "b"], "left_anti").select("id", "c")
        pairs = materialize(pairs, f"pairs-{step}")
        drop(centre, roots)
        new = materialize(verified(pairs, sets, percent), f"verified-{step}")
        drop(pairs)
        spent.append(new)
        found = new if found is None else found.unionByName(new)
        roots = components(_ordered(found.filter("linked")))
    drop(*spent)
    return roots


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``id_col``, n_shingles, component_id for each row (and ``row_col`` if there is one)."""
    own = docs.withColumnRenamed(row_col, ROW) if row_col else numbered(docs, ROW)
    rows = materialize(document_sets(own, id_col, text_col, words, [ROW]), "document-sets")
    # A class is known by one of its name's longs: the first, unless another class has that too.
    named = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.min(ROW).alias(ROW), F.min(id_col).alias("doc"), F.first("n_shingles").alias("n_shingles"))
    named = materialize(named, "named-sets")
    clash = [r[0] for r in named.groupBy("f1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(CLASHES + 1).collect()]
    if len(clash) > CLASHES:
        raise ValueError("more classes than 64-bit names can tell apart")
    ident = F.when(F.col("f1").isin(clash), F.col("f2")).otherwise(F.col("f1")) if clash else F.col("f1")
    classes = named.withColumn("id", ident)

    common, hot = sampled(own, classes, text_col, words, percent)
    met = materialize(meeting(part_keys(own, text_col, words, percent, common, frozenset(clash), hot), hot), "meeting")
    sets = materialize(class_sets(own, classes, met.select("id").distinct(), text_col, words), "class-sets")
    roots = class_roots(met, sets, percent)
    drop(met, sets)

    with_root = classes.join(roots.select("id", "root"), "id", "left").select("f1", "f2", "doc", F.coalesce("root", "id").alias("root"))
    least = with_root.groupBy("root").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("n"))
    # Only what a link or a repeated set could change goes through a join; so no class of thousands meets in one task.
    sized = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("copies"))
    names = with_root.join(least, "root").join(sized, ["f1", "f2"]).select("f1", "f2", "component", "copies")
    names = materialize(names, "components")
    drop(named, roots)
    total = rows.count()
    found = join_counted(rows.filter("n_shingles > 0"), names, ["f1", "f2"], "copies", total).drop("copies")
    alone = rows.filter("n_shingles = 0").withColumn("component", F.col(id_col))
    out = found.unionByName(alone).select(id_col, "n_shingles", F.col("component").alias("component_id"), ROW)
    return out.withColumnRenamed(ROW, row_col) if row_col else out.drop(ROW)


def near_dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the least id, and all rows that link with nothing; all columns stay."""
    own = numbered(docs, ROW)
    groups = materialize(near_groups(own, words, percent, id_col, text_col, ROW), "near-groups")
    alone = groups.filter("n_shingles = 0").select(ROW)
    best = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min_by(ROW, F.struct(F.col(id_col).isNull(), id_col, ROW)).alias(ROW)).select(ROW)
    return own.join(alone.unionByName(best), ROW, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
