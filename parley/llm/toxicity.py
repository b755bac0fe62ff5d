"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word, lower-cased and with marks at its ends taken off, is the mean of the vectors of its character n-grams (3 to 7, with
word ends), hashed to ``BUCKETS``; a document is the mean of its words.  A misspelling that was never seen shares most of its
n-grams with what was.  N-grams that tell nothing about the classes by themselves have no vector, so they are not learned by
heart.  After training a word acts through one number, kept by workers for recent distinct words.

Fitted in the driver on at most ``SAMPLE`` labelled rows that are not held out, the first by a hash, and as many of these as
have ``SAMPLE_CHARS`` code points together (one text has a twentieth of that at most); scoring reads whole texts.

Defined results: a very long text is scored whole, as one block; null, empty and wordless texts have the score of the bias alone; without labels of both kinds every score is
the share of label 1, or 0.5 without labels; repeated rows are scored each; an empty table gives an empty table; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, documents, read_table
from .labelled import first_rows, sample, with_scores

SAMPLE, SAMPLE_CHARS = 6_000, 40_000_000
THRESHOLD = 0.3
BUCKETS, WIDTH, SIZES = 1 << 18, 4, (3, 4, 5, 6, 7)
STEPS, RATE, SCALE = 150, 0.05, 120.0
#: A bucket has a vector from this many standard deviations and documents on; the strongest ones have it in any case.
DEVIATION, LEAST_DOCS, LEAST_BUCKETS = 6.0, 5, 200
EDGE = ".,;:!?#*$%&|<>\"'()[]{}"
KINDS = 200_000
#: Words whose n-grams are made together.
PART = 20_000
PRIME = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, and the index of the word of each; in order of words."""
    framed = [f"<{w.strip(EDGE)}>" for w in words]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))
    buckets, owners = [], []
    key = np.full(len(points), 0xCBF29CE484222325, np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        key = (key[:m] ^ points[n - 1 :]) * PRIME
        if n in SIZES:
            ok = left[:m] >= n
            mixed = key[ok] ^ (key[ok] >> np.uint64(31))
            buckets.append(((mixed * PRIME) >> np.uint64(20)).astype(np.int64) % BUCKETS)
            owners.append(owner[:m][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


def word_means(words: list[str], values: np.ndarray) -> np.ndarray:
    """The mean of ``values`` (by bucket) over each word's n-grams."""
    buckets, owners = subwords(words)
    return np.bincount(owners, values[buckets], len(words)) / np.maximum(np.bincount(owners, minlength=len(words)), 1)


def _pieces(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of the words: where it begins, buckets, the index of the word of each, 1 / n-grams of each word."""
    for at in range(0, len(words), PART):
        part = words[at : at + PART]
        found, of = subwords(part)
        yield at, found, of, 1 / np.maximum(np.bincount(of, minlength=len(part)), 1)


def word_shares(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and for each document and word of it their indexes and the word's share of the document."""
    number: dict[str, int] = {}
    doc, word, share = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for i, text in enumerate(texts):
        own = Counter(words_of(text))
        if own:
            counts = np.fromiter(own.values(), float, len(own))
            doc.append(np.full(len(own), i, np.int32))
            word.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
            share.append(counts / counts.sum())
    return list(number), np.concatenate(doc), np.concatenate(word), np.concatenate(share)


def telling(words: list[str], toxic: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Which buckets get a vector: those whose words are far more or far less often in toxic documents than all words are.

    ``toxic`` and ``every`` count each word's documents.  The rest could only be learned by heart.
    """
    of_toxic, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for at, found, of, _ in _pieces(words):
        of_toxic += np.bincount(found, toxic[of + at], BUCKETS)
        n += np.bincount(found, every[of + at], BUCKETS)
    p = of_toxic.sum() / max(n.sum(), 1)
    deviation = np.abs(of_toxic - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    deviation[n < LEAST_DOCS] = 0
    return deviation >= max(min(DEVIATION, np.sort(deviation)[-LEAST_BUCKETS]), 1e-9)


class Bag:
    """``effect``: what each bucket adds to the logit of label 1."""

    def __init__(self, effect: np.ndarray, bias: float):
        self.effect, self.bias = effect, bias
        self.known: Recent | None = None

    def __getstate__(self):
        return {"effect": self.effect, "bias": self.bias, "known": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.known is None:
            self.known = Recent(KINDS)
        lists = [words_of(t) for t in texts]
        kinds = list(set().union(*lists))
        found = self.known.get(kinds)
        new = [w for w, v in zip(kinds, found) if v is None]
        table = dict(zip(kinds, found))
        if new:
            made = word_means(new, self.effect).tolist()
            self.known.put(new, made)
            table.update(zip(new, made))
        logit = np.array([sum(map(table.__getitem__, w)) / len(w) if w else 0.0 for w in lists]) * SCALE + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray) -> Bag:
        share = float(y.mean()) if len(y) else 0.5
        bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        effect = np.zeros(BUCKETS, np.float32)
        words, doc, word, part = word_shares(texts)
        if not len(words) or not 0 < share < 1:
            return cls(effect, bias)
        told = telling(words, np.bincount(word, y[doc], len(words)), np.bincount(word, minlength=len(words)))
        # A sparse table of documents by buckets, made once: the mean over words of the mean over n-grams.
        buckets, owners, inverse = [], [], []
        for at, found, of, inv in _pieces(words):
            keep = told[found]
            buckets.append(found[keep])
            owners.append(of[keep] + at)
            inverse.append(inv)
        used, column = np.unique(np.concatenate(buckets), return_inverse=True)
        begin = np.searchsorted(np.concatenate(owners), np.arange(len(words) + 1))
        n = np.diff(begin)[word]
        at = np.repeat(begin[word] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        cell, of = np.unique(np.repeat(doc, n).astype(np.int64) * len(used) + column[at], return_inverse=True)
        value = np.bincount(of, np.repeat(part * np.concatenate(inverse)[word], n)) * SCALE
        row, column = cell // max(len(used), 1), cell % max(len(used), 1)

        rng = np.random.default_rng(7)
        params = [rng.normal(0, 0.05, (WIDTH, len(used))), rng.normal(0, 1, (WIDTH, 2)), np.array([0.0, bias])]
        first, second = [0.0] * 3, [0.0] * 3
        for step in range(1, STEPS + 1):
            embed, head, b = params
            toward = head[:, 1] - head[:, 0]
            # Of two classes the softmax is a logistic of the difference of their logits.
            logit = np.bincount(row, (toward @ embed)[column] * value, len(y)) + b[1] - b[0]
            delta = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
            back = np.bincount(column, delta[row] * value, len(used))
            slope = embed @ back
            grads = [np.outer(toward, back), np.stack([-slope, slope], axis=1), np.array([-delta.sum(), delta.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        embed, head, b = params
        effect[used] = (head[:, 1] - head[:, 0]) @ embed
        return cls(effect, float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Bag:
    own = first_rows(sample(docs, labels, label, rows, chars // 20, id_col, text_col), rows, id_col)
    # At most ``rows`` rows: one task.
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64(F.col(id_col)), id_col).rowsBetween(Window.unboundedPreceding, 0))
    table = own.select("label", "text", upto.alias("upto")).filter(F.col("upto") <= chars).select("label", "text").toArrow()
    return Bag.fit(table.column("text").to_pylist(), np.array(table.column("label").to_pylist(), float))


def toxicity(docs: DataFrame, model: Bag, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted for each row."""
    return with_scores(docs, model.score, threshold, id_col, text_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
