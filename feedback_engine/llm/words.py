"""Words of whole byte buffers at once, and Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feedback_engine.llm.shingles import _BYTE, _INVERSE, _P, _mix, _powers

SLICE_BYTES = 1_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most`` bytes of text; a longer text is a run of its own.

    What a task derives from a text is thereby bounded by bytes, whatever the number of rows in a batch.
    """
    texts = batch.column(column)
    sizes = np.zeros(len(texts) + 1, np.int64)
    lengths = pc.fill_null(pc.binary_length(texts), 0)
    np.cumsum(lengths.to_numpy(zero_copy_only=False), out=sizes[1:])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@lru_cache(maxsize=2)
def _table(base: int, size: int) -> np.ndarray:
    return _powers(np.uint64(base), size)


def _powers_upto(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n - 1; a task keeps the table for slices of the usual size."""
    return _table(int(base), SLICE_BYTES + 2)[:n] if n <= SLICE_BYTES + 2 else _powers(base, n)


def joined_bytes(texts: pa.Array) -> bytes:
    """The bytes of all texts of an Arrow column one after the other, without a Python object for each."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[[texts.offset, texts.offset + len(texts)]] if len(texts) else (0, 0)
    return data[int(at[0]) : int(at[1])].to_pybytes() if data is not None else b""


def scan(data: bytes, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word: runs of bytes not marked in the table ``blank`` (256 booleans)."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~blank[raw]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers_upto(_P, len(raw)), out=sums[1:])
    back = _powers_upto(_INVERSE, len(raw) + 1)
    return starts, ends, _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def chained(words: np.ndarray, seed: int | np.ndarray = 0) -> np.ndarray:
    """Hash of each row of word hashes; ``seed`` may differ from row to row."""
    total = np.zeros(len(words), np.uint64) + np.asarray(seed, np.uint64)
    for column in words.T:
        total = total * _STEP + column
    return _mix(total + np.uint64(words.shape[1]))


def windows(hashes: np.ndarray, width: int, seed: int | np.ndarray = 0) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    return chained(np.lib.stride_tricks.sliding_window_view(hashes, width), seed)
