"""NumPy text kernels over Arrow string columns: word bounds, word hashes, shingles.

Texts are handled as the bytes of the Arrow buffer, many documents at once; no
Python loop runs over words. Pieces bound the memory: a piece holds whole texts
of about ``PIECE`` bytes together, or one longer text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes that aren't ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words are runs of ASCII letters and digits and of all bytes above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def release() -> None:
    """Give the memory that a task has freed back to the system. Workers serve many tasks and would keep it until they end."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc only
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _K
    h = h ^ (h >> np.uint64(29))
    h = h * _BASE
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + (PIECE >> 1))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values (null: empty) and the n + 1 bounds between them."""
    col = pc.fill_null(col, "") if col.null_count else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return (raw[off[0] : off[-1]], off - off[0]) if len(raw) else (raw, off - off[0])


def pieces(batch: pa.RecordBatch, col: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right"))
        b = max(a + 1, b)
        yield batch.slice(a, b - a)
        a = b


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 bounds of the texts' words. A word never crosses texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    cut = bounds[:-1][bounds[:-1] < n]
    before[cut] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[-1] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased, equal wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n word hashes."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        out = out * _K + h[i : len(h) - n + 1 + i]
    return mix(out ^ np.uint64(n))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
