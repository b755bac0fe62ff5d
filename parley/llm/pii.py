"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs with a digit, digits, schemes, and words that announce
an identifier.  A parser for each kind expands an anchor to both sides, decides where the span begins and ends, and validates
it.  Kinds are found apart from each other: spans of one kind never overlap, those of different kinds may.

Base kinds: email, ip, card, phone.  Added kinds: account (an identifier after a cue word, or an IBAN with a right check
number) and login (user and password in a URL).  Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows are searched each; an empty table gives an empty table;
further columns of the input are ignored by the finder and kept by the redaction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, give_back, map_texts, text_list

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
#: Words before an identifier, in any mix of cases; words that may stand between the two; schemes.
CUES = ["account number", "account no", "account", "acct", "iban", "passport", "ssn", "tax id", "customer id", "policy number"]
BETWEEN = ("number", "num", "no", "id")
SCHEMES = ["http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://"]

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SIGNS = frozenset(" \t:=#.")
Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, letters: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in letters:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def email(text: str, at: int, after: int) -> int | tuple[int, int]:
    """Around the at-sign: (start, end), or where the next one may begin."""
    start = at
    while start > after and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return after
    labels = 0
    while text[end : end + 1] == "." and (more := run_end(text, end + 1, LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else after


def ip(text: str, at: int) -> tuple[int, bool]:
    """From a digit that begins a run: where the match or, without one, the run ends; whether four parts are there."""
    first = end = run_end(text, at, DIGITS)
    for _ in range(3):
        if text[end : end + 1] != "." or (more := run_end(text, end + 1, DIGITS)) == end + 1:
            return first, False
        end = more
    return end, True


def card(text: str, at: int) -> int:
    """From a digit: the end of the digits that single blanks and hyphens join."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and text[end + 1 : end + 2] in DIGITS and end + 1 < n:
            end += 2
        else:
            break
    return end


def phone(text: str, plus: int) -> int:
    """From a plus sign before a digit: the end, or 0."""
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in DIGITS else 0


def lowered(text: str) -> str:
    """The text with ASCII letters in lower case, of the same length."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def account(text: str, after_cue: int) -> tuple[int, int] | None:
    """Behind a cue word: blanks, colons, signs, a word such as "number" and "is", then an identifier of 6 to 34 letters and digits with 4 digits.

    Where nothing follows that word, it is read as a part of the identifier.
    """
    if text[after_cue : after_cue + 1] in ALNUM and after_cue < len(text):
        return None
    at = run_end(text, after_cue, SIGNS)
    end = run_end(text, at, ALNUM) if at > after_cue else at
    if 2 <= end - at <= 6 and text[at:end].lower() in BETWEEN and (more := run_end(text, end, SIGNS)) > end and (hit := identifier(text, more)):
        return hit
    return identifier(text, at)


def identifier(text: str, at: int) -> tuple[int, int] | None:
    if text[at : at + 3].lower() == "is ":
        at = run_end(text, at + 3, frozenset(" :"))
    end = at
    while end < len(text) and (text[end] in ALNUM or text[end] in " -" and end > at and text[end + 1 : end + 2].isdigit()):
        end += 1
    value = [c for c in text[at:end] if c in ALNUM]
    return (at, end) if 6 <= len(value) <= 34 and sum(c in DIGITS for c in value) >= 4 else None


def iban(text: str, at: int) -> tuple[int, int] | None:
    """Around two digits after two capital letters that begin a word."""
    start = at - 2
    if start < 0 or not (text[start : at].isascii() and text[start : at].isupper() and text[start : at].isalpha()) or start and text[start - 1] in ALNUM or not text[at : at + 2].isdigit():
        return None
    end, value = start, ""
    while end < len(text) and len(value) < 34 and (text[end] in ALNUM or text[end] == " " and text[end + 1 : end + 2] in ALNUM and end + 1 < len(text)):
        if text[end] in ALNUM:
            value += text[end]
        end += 1
        if len(value) >= 15 and (end == len(text) or text[end] not in ALNUM):
            turned = value[4:] + value[:4]
            if turned.isupper() or turned.isdigit():
                if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                    return start, end
    return None


def login(text: str, after_scheme: int) -> tuple[int, int] | None:
    """Behind a scheme: user and password up to the at-sign of the host."""
    end = after_scheme
    while end < len(text) and not text[end].isspace() and text[end] not in "/@?#\"'<>":
        end += 1
    return (after_scheme, end) if text[end : end + 1] == "@" and ":" in text[after_scheme:end] else None


def spans(text: str) -> list[Span]:
    """All spans by start, then kind."""
    found: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (anchor, size) in automaton().iter(lowered(text)):
        at = last - size + 1
        if anchor == "digit":
            if at >= free["card"]:
                end = free["card"] = card(text, at)
                digits = [c for c in text[at:end] if c in DIGITS] if end - at >= 14 else []
                if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                    found.append(("card", at, end))
            if at >= free["ip"]:
                end, whole = ip(text, at)
                free["ip"] = end
                if whole and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text[at:end].split(".")):
                    found.append(("ip", at, end))
            if at >= 2 and at >= free["account"] and text[at - 1].isupper() and (hit := iban(text, at)):
                found.append(("account", *hit))
                free["account"] = hit[1]
        elif anchor == "plus":
            if at >= free["phone"] and (end := phone(text, at)):
                free["phone"] = end
                if 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    found.append(("phone", at, end))
        elif anchor == "at":
            hit = email(text, at, free["email"])
            if isinstance(hit, tuple):
                found.append(("email", *hit))
                free["email"] = hit[1]
        elif anchor == "cue":
            if at >= free["account"] and (at == 0 or text[at - 1] not in ALNUM) and (hit := account(text, last + 1)):
                found.append(("account", *hit))
                free["account"] = hit[1]
        elif text[at : last + 1].islower() and at >= free["login"] and (hit := login(text, last + 1)):
            found.append(("login", *hit))
            free["login"] = hit[1]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def redacted(text: str, found: list[Span] | None = None) -> str:
    """The text with each stretch of spans as its first kind in brackets."""
    out, done, end = [], 0, -1
    for kind, a, b in spans(text) if found is None else found:
        if a >= end:
            out += [text[done:a], f"[{kind.upper()}]"]
        end = done = max(b, end)
    return "".join([*out, text[done:]]) if out else text


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and spans array<struct<kind, start, end>> of every row."""

    def make(texts: list[str]) -> dict:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return {"spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts], kind)}

    return map_texts(docs, [id_col], text_col, "spans array<struct<kind:string,start:int,end:int>>", make)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as a string."""

    def make(texts: list[str]) -> dict:
        every = [spans(t) for t in texts]
        base = [[s for s in own if s[0] in BASE] for own in every]
        counts = {f"n_{kind}": pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in BASE}
        return counts | {"base_sha256": [hashlib.sha256(written(own).encode()).hexdigest() for own in base], "spans": [written(own) for own in every]}

    columns = ", ".join(f"n_{kind} long" for kind in BASE) + ", base_sha256 string, spans string"
    return map_texts(docs, [id_col], text_col, columns, make)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the spans in ``text_col`` replaced; null stays null."""
    columns = docs.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_list(batch, text_col)
            null = batch.column(place).is_null().to_pylist()
            for a, b in blocks(texts):
                new = pa.array([None if gone else redacted(t) for t, gone in zip(texts[a:b], null[a:b])], pa.string())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(part.columns)], names=columns)
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
