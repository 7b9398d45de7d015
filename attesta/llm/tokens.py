"""Byte-level BPE token ids of whole texts, equal to those of the `tokenizers` library for the same file."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np


def _byte_chars() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """encode(text) -> little-endian unsigned 32-bit ids as bytes.

    Texts go through a merge engine over the same ranks, whole; those with special strings through `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.engine = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        """For texts with special strings; loaded when the first one comes."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.asarray(self.engine.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One per Python worker and file."""
    return Tokens(path)
