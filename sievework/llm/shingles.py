"""Word hashes of texts in numpy: polynomial hashes of all words of a batch at once, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_PLAIN[65:91] += 32
#: Bytes of text that are hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK) + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _hash_bytes(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each document and after the last)."""
    n = len(data)
    power, inverse = _powers_to(n)
    solid = ~_SPACE[data]
    first = np.zeros(n, bool)
    first[doc_starts[doc_starts < n]] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[e] - total[s]) * inverse[s] ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(s, np.append(doc_starts, n))


def word_chunks(texts: pa.Array, signs_split: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row and after the last) of stretches of a string column; null is empty.

    signs_split: ASCII signs part words as white space does, and ASCII letters are lower-cased.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        stop = min(stop, len(texts))
        data = raw[offsets[row] : offsets[stop]]
        yield row, *_hash_bytes(_PLAIN[data] if signs_split else data, offsets[row:stop] - offsets[row])
        row = stop


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hash of each of its words) of a string column; null is empty."""
    for first, hashes, at in word_chunks(texts):
        for k in range(len(at) - 1):
            yield first + k, hashes[at[k] : at[k + 1]]


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; a shorter text is one run."""
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return mix(out)
