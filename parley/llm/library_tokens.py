"""Ids of a byte-level vocabulary file by the ``tokenizers`` library, once for each distinct pre-token.

Held for a worker process, for at most twice ``KINDS`` pre-tokens.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .common import Recent
from .pretokens import Split

#: Distinct pre-tokens that a worker remembers; about 150 bytes each.
KINDS = 150_000


class Library:
    def __init__(self, path: str, ids: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if len(added) > 1:
            raise ValueError("one special string at most is supported")
        self.special, self.special_id = next(((t.content, i) for i, t in added.items()), (None, -1))
        self.ids = ids
        self.known = Recent(KINDS)

    def look_up(self, kinds: list[str]) -> list:
        """The ids (as bytes of little-endian uint32) or the number of ids of each pre-token."""
        found = self.known.get(kinds)
        new = [k for k, v in zip(kinds, found) if v is None]
        if new:
            made = self.library.encode_batch_fast(new, add_special_tokens=False)
            got = [np.array(e.ids, "<u4").tobytes() for e in made] if self.ids else [len(e) for e in made]
            fresh = dict(zip(new, got))
            found = [fresh[k] if v is None else v for k, v in zip(kinds, found)]
            self.known.put(new, got)
        return found

    def split(self, texts: list[str]) -> Split:
        return Split(texts, self.special)


@lru_cache(maxsize=4)
def library(path: str, ids: bool) -> Library:
    return Library(path, ids)
