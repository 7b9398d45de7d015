"""64-bit ids of words, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of texts whose words are hashed at once; words of more bytes are hashed one by one.
CHUNK, LONG_WORD = 1 << 21, 64
_WHITE, _LOWER = np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER[65:91] += 32
#: The first so many bytes of eight.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
C = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    joined = b"\n".join([b"", *texts, b" " * 8])
    low = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    white = _WHITE[low]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    eight = np.ndarray((low.size - 7,), dtype="<u8", buffer=low, strides=(1,))
    h = size.astype(np.uint64) * C
    for at in range(0, int(min(size.max(initial=0), LONG_WORD)), 8):
        live = np.flatnonzero(size > at) if at else slice(None)
        part = eight[begin[live] + at] & _MASK[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ part) * C)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(low[begin[i] : end[i]].data)
    ends = np.cumsum([1 + len(x) for x in texts]) + 1
    return np.split(h, np.searchsorted(begin, ends)[:-1])


def batch_ids(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit ids of each text's words, A-Z lowered, cut at ASCII white space. A word is hashed eight bytes at a time,
    all words of CHUNK bytes of texts at once."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= CHUNK:
            yield from _hashed(held)
            held, size = [], 0
    if held:
        yield from _hashed(held)


def word_ids(text: bytes) -> np.ndarray:
    return _hashed([text])[0]
