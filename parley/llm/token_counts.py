"""Token counts without token ids.

Each block of documents is split into pre-tokens; the distinct ones are counted once by the library; the counts are joined
by number to the block's (document, pre-token) frequencies and summed.  Ids are never made into a column or an array.  The
join is local to a block: a global one would shuffle every (document, pre-token) pair, several times the input.

Defined results: a very long text is counted whole, as one block; null and empty text count 0 tokens and 0 bytes; repeated rows are counted each; an empty table gives an
empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts
from .library_tokens import library
from .pretokens import distinct


def count_block(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    lib = library(path, False)
    split = lib.split(texts)
    codes, kinds = distinct([split])
    n_docs = len(texts)
    if not len(codes):
        return np.zeros(n_docs, np.int64)
    counts = np.array(lib.look_up(kinds), np.int64)
    # (document, pre-token) frequencies of the block, then the join with the counts and the sum.
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(split.doc_first))
    pair, times = np.unique(doc * len(kinds) + codes, return_counts=True)
    return np.bincount(pair // len(kinds), weights=counts[pair % len(kinds)] * times, minlength=n_docs).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for each row of ``docs``; ``path``: a byte-level vocabulary for ``tokenizers``."""

    def make(texts: list[str]) -> dict:
        n = count_block(texts, path)
        return {"n_bytes": np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)), "n_tokens": n, "over_limit": n > limit}

    return map_texts(docs, [id_col], text_col, "n_bytes long, n_tokens long, over_limit boolean", make)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
