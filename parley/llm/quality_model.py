"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are binned by quantiles; each tree is grown level by level from histograms of gradients to a fixed depth and kept
as arrays in heap order, so that scoring a block of documents is ``depth`` vectorised look-ups over documents and trees.
Fitted in the driver on at most ``SAMPLE`` labelled rows that are not held out: executors compute the statistics and only
these numbers are collected.

Defined results: a very long text is one block and read whole; null and empty texts have the statistics of an empty text and a score; without labels of both kinds every
score is the share of label 1, or 0.5 without labels; repeated rows are scored each; an empty table gives an empty table;
further columns of the input are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts, read_table
from .labelled import first_rows, keep_rows, sample, with_scores

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, PENALTY, LEAST = 80, 4, 64, 0.15, 1.0, 4.0
#: Classes of characters that statistics count: white space, line feed, lower case, upper case, digit, then these groups.
GROUPS = ["#*$%&|<>", "!?", ".,;:", "\"'()[]{}", "-_/\\@+=~^`"]
N_CLASSES = 6 + len(GROUPS)
N_STATS = N_CLASSES - 1 + 10


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x3000):
        c = chr(point)
        table[point] = 2 if c == "\n" else 1 if c.isspace() else 4 if c.isupper() else 3 if c.isalpha() else 5 if c.isdigit() else 0
    for i, group in enumerate(GROUPS):
        table[[ord(c) for c in group]] = 6 + i
    return table


CLASSES = _classes()


def statistics(texts: list[str]) -> np.ndarray:
    """A row of N_STATS numbers for each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)) * N_CLASSES, lengths)
    counts = np.bincount(owner + CLASSES[points], minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES)
    out = np.zeros((len(texts), N_STATS))
    out[:, : N_CLASSES - 1] = counts[:, 1:] / np.maximum(lengths, 1)[:, None]
    for i, text in enumerate(texts):
        words, lines = text.split(), text.split("\n")
        n, pairs = len(words), max(len(words) - 1, 1)
        out[i, N_CLASSES - 1 :] = (
            np.log1p(n),
            np.log1p(len(text)),
            len(text) / max(n, 1),
            len(set(words)) / max(n, 1),
            len(set(zip(words, words[1:]))) / pairs,
            sum(map(eq, words, words[1:])) / pairs,
            len(words[0]) if words else 0,
            np.log1p(len(lines)),
            len(set(lines)) / len(lines),
            n / len(lines),
        )
    return out


class Trees:
    """Complete binary trees in heap order: feature, threshold of inner nodes and leaf values, one row for each tree."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            inner = self.feature.shape[1]
            for _ in range(int(inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            share = min(max(share, 1e-6), 1 - 1e-6)
            return cls(float(np.log(share / (1 - share))), np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        upper = np.full((f, BINS), np.inf)
        for j, c in enumerate(cuts):
            upper[j, : len(c)] = c
        raw = np.full(n, np.log(share / (1 - share)))
        base, inner = float(raw[0]), (1 << DEPTH) - 1
        features, thresholds, leaves = [], [], []
        cell = np.arange(f)[None, :] * BINS + binned
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                width, first = 1 << level, (1 << level) - 1
                at = ((node - first)[:, None] * (f * BINS) + cell).ravel()
                sums = [np.bincount(at, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :1, -1:] for s in sums)
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - gt**2 / (ht + PENALTY)
                gain = np.where((hl >= LEAST / 4) & (hr >= LEAST / 4) & np.isfinite(upper)[None], gain, -1).reshape(width, -1)
                best = gain.argmax(axis=1)
                good = gain[np.arange(width), best] > 1e-9
                feature[first : first + width] = best // BINS
                threshold[first : first + width] = np.where(good, upper[best // BINS, best % BINS], np.inf)
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = -RATE * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + PENALTY)
            raw += leaf[node - inner]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(leaf)
        return cls(base, np.array(features), np.array(thresholds), np.array(leaves))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    import pyarrow as pa

    def make(texts: list[str]) -> dict:
        return {"x": pa.FixedSizeListArray.from_arrays(pa.array(statistics(texts).ravel()), N_STATS).cast(pa.list_(pa.float64()))}

    found = map_texts(sample(docs, labels, label, rows, None, id_col, text_col), [id_col, "label"], "text", "x array<double>", make)
    table = first_rows(found, rows, id_col).toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, N_STATS)
    return Trees.fit(x, np.array(table.column("label").to_pylist(), float))


def quality(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted for each row."""
    return with_scores(docs, lambda texts: model.score(statistics(texts)), threshold, id_col, text_col)


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that the classifier doesn't reject, with all columns."""
    return keep_rows(docs, text_col, lambda texts: model.score(statistics(texts)) >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
