"""Vectorised byte-level pre-tokenisation.

Splits a block of texts exactly as ``public_tokenizers.PATTERN`` does, with numpy over code points instead of one regular
expression call for each match, then numbers the block's distinct pre-tokens so that callers work once for each of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pandas._libs.hashtable import UInt64Factorizer

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Odd, and one above twice an odd number, so that powers keep the order of characters apart.
BASE = 0x9E3779B97F4A7C13
MASK = (1 << 64) - 1
#: Words of two letters in the order of Thue and Morse have the same hash from 1,024 characters on.
LONG = 256


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = "".join(regex.findall(name + "+", every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def char_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below 2**bits, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        for k in range(bits):
            p = np.concatenate([p, p * np.uint64(pow(base, 1 << k, 1 << 64))])
        out.append(p)
    return out[0], out[1]


class Split:
    """The pre-tokens of a block of texts.

    text: the texts, joined. starts, ends: of each pre-token in it. doc_first: the number of pre-tokens before each text, and
    their total. is_special: marks pre-tokens that are the special string.
    """

    def __init__(self, texts: list[str], special: str | None = None):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = len(points)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(lengths)])
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        spans = self._find(texts, at, special) if special and special in self.text else []
        for a, b in spans:
            cut[a] = cut[b] = True
        kind = classes()[points]
        first = cut[:n].copy()
        first[1:] |= kind[1:] != kind[:-1]
        # A run of white space gives its last character to what follows, or leaves it alone if it is not a space.
        after = np.flatnonzero(first & ~cut[:n])
        after = after[(kind[after] != SPACE) & (kind[after - 1] == SPACE)]
        first[after - 1] = True
        first[after[points[after - 1] == 0x20]] = False
        self._contractions(points, first, cut, n)
        for a, b in spans:
            first[a + 1 : b] = False
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], n)
        self.doc_first = np.searchsorted(self.starts, at)
        self.points = points
        self.is_special = np.isin(self.starts, [a for a, _ in spans]) if spans else None

    @staticmethod
    def _find(texts: list[str], at: np.ndarray, special: str) -> list[tuple[int, int]]:
        found = []
        for text, base in zip(texts, at.tolist()):
            k = text.find(special)
            while k >= 0:
                found.append((base + k, base + k + len(special)))
                k = text.find(special, k + len(special))
        return found

    @staticmethod
    def _contractions(points: np.ndarray, first: np.ndarray, cut: np.ndarray, n: int) -> None:
        p = np.flatnonzero(points == 39)
        p = p[first[p] & (p + 1 < n)]
        p = p[~cut[p + 1]]
        one = points[p + 1]
        two = np.where((p + 2 < n) & ~cut[np.minimum(p + 2, n)], points[np.minimum(p + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for q, size in ((p[short], 2), (p[long], 3)):
            first[q + 1] = False
            end = q + size
            first[end[end < n]] = True

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each pre-token."""
        n = len(self.points)
        up, down = powers(max(21, int(n).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(char_values()[self.points] * up[:n], out=total[1:])
        key = (total[self.ends] - total[self.starts]) * down[self.starts]
        key ^= key >> np.uint64(29)
        return key

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[i:j] for i, j in zip(self.starts[which].tolist(), self.ends[which].tolist())]


class Kinds:
    """Numbers the distinct pre-tokens of one split after another, in order of first appearance; ``strings`` are they.

    Kinds are told apart by hash, with length and last character compared, long ones with the strings compared too; from a
    clash on, by the strings.
    """

    def __init__(self):
        self.strings: list[str] = []
        self.table, self.look = UInt64Factorizer(1 << 16), np.zeros(0, np.int64)
        self.by_string: dict[str, int] | None = None

    def number(self, split: Split) -> np.ndarray:
        """The number of each pre-token's kind."""
        if not len(split.starts):
            return np.zeros(0, np.int64)
        if self.by_string is None:
            n, codes = len(self.strings), self.table.factorize(split.keys())
            look = (split.ends - split.starts) * 0x110000 + split.points[split.ends - 1]
            new = np.flatnonzero(codes >= n)[::-1]
            where = np.zeros(self.table.get_count() - n, np.int64)
            where[codes[new] - n] = new  # the first appearance is written last
            self.look = np.append(self.look, look[where])
            if np.array_equal(self.look[codes], look):
                self.strings += split.strings(where)
                long = np.flatnonzero(split.ends - split.starts >= LONG)
                if all(self.strings[c] == x for c, x in zip(codes[long].tolist(), split.strings(long))):
                    return codes
                del self.strings[n:]
            self.by_string = {x: i for i, x in enumerate(self.strings)}
        known = self.by_string
        codes = np.array([known.setdefault(x, len(known)) for x in split.strings(np.arange(len(split.starts)))], np.int64)
        self.strings = list(known)
        return codes


def distinct(splits: list[Split]) -> tuple[np.ndarray, list[str]]:
    """The number of each pre-token's kind over all splits, and the kinds in order of first appearance."""
    kinds = Kinds()
    codes = [kinds.number(s) for s in splits]
    return np.concatenate([np.zeros(0, np.int64), *codes]), kinds.strings


def spread(values: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[first:first+size] of each code, one after another, and where each begins (and the total)."""
    lens = size[codes]
    begin = np.concatenate([[0], np.cumsum(lens)])
    index = np.repeat(first[codes] - begin[:-1], lens)
    index += np.arange(begin[-1])
    return values[index], begin
