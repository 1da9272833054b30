"""Token ids of a public byte-level tokenizer, with a cache of frequent words.

The pre-tokenizer never joins a word with the text before a single blank, so a text may be cut
before such blanks and the parts encoded one by one; frequent parts come from a dictionary.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Encodes texts; ``path`` names a file of ranks (base64 token, rank)."""

    LONGEST = 24
    """Longer parts are encoded but not kept."""
    MOST = 300_000

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.parts: dict[str, tuple[int, ...]] = {}

    def _part(self, part: str) -> tuple[int, ...]:
        ids = tuple(self.encoding.encode_ordinary(part))
        if len(part) <= self.LONGEST:
            if len(self.parts) >= self.MOST:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of ``encode_ordinary(text)``."""
        cut = text.split(" ")
        if "" in cut:  # runs of blanks, or one at an end, are tokens of their own
            return self.encoding.encode_ordinary(text)
        get, make = self.parts.get, self._part
        ids = list(make(cut[0]))
        for x in cut[1:]:
            x = " " + x
            ids += get(x) or make(x)
        return ids

    def count(self, text: str) -> int:
        """The number of tokens of ``text``."""
        cut = text.split(" ")
        if "" in cut:
            return len(self.encoding.encode_ordinary(text))
        get, make = self.parts.get, self._part
        n = len(make(cut[0]))
        for x in cut[1:]:
            x = " " + x
            n += len(get(x) or make(x))
        return n


@lru_cache(2)
def tokenizer(path: str = DEFAULT) -> Tokenizer:
    """The tokenizer of a file, loaded once in a process."""
    return Tokenizer(path)
