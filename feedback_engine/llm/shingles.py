"""Sets of hashed word shingles, for whole Arrow columns of text at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK = 500_000  # bytes of text hashed at a time: temporary arrays stay below some 50 MB
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _hash_chunk(data: np.ndarray, bounds: np.ndarray, n_words: int) -> list[np.ndarray]:
    """``data``: bytes of several texts; ``bounds``: where each begins, and the end."""
    step = _powers(_BASE, n_words)
    n_docs = len(bounds) - 1
    space = _SPACE[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = word[inner]  # a text's first word begins at its start
    last = word.copy()
    last[:-1] &= space[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = _powers(_P, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers[:-1], out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    of_doc = np.searchsorted(starts, bounds)  # words before each text's begin
    out = []
    for d in range(n_docs):
        own = words[of_doc[d] : of_doc[d + 1]]
        if not len(own):
            out.append(np.zeros(0, np.uint64))
            continue
        width = min(n_words, len(own))
        total = np.zeros(len(own) - width + 1, np.uint64)
        for j in range(width):
            total += own[j : len(own) - width + 1 + j] * step[j]
        out.append(np.unique(_mix(total + np.uint64(width))))
    return out


def sets_of(texts: pa.Array, n_words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text.

    A-Z are lower-cased, words are runs of other bytes than 0x20 and 0x09-0x0D. A text with fewer than ``n_words`` words is
    one shingle; null and word-less texts have none.
    """
    raw = [(t.as_py() or "").encode() for t in texts] if isinstance(texts, pa.ChunkedArray) else [
        (t or "").encode() for t in texts.to_pylist()
    ]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        size, end = 0, at
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
            size += len(raw[end])
            end += 1
        bounds = np.zeros(end - at + 1, np.int64)
        np.cumsum([len(r) for r in raw[at:end]], out=bounds[1:])
        out += _hash_chunk(np.frombuffer(b"".join(raw[at:end]), np.uint8), bounds, n_words)
        at = end
    return out
