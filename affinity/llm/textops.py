"""Small numpy helpers that run inside tasks on slices of an Arrow text column.

Words are the maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; both are ASCII, so this is
the same on UTF-8 bytes as on characters. Nothing here keeps more than one slice in memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SMALL_BYTES = 1 << 19  # for steps that hold many times the text at once
HASH_BYTES = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs.astype(np.int64) - offs[0]


def release() -> None:
    """Hand freed memory back to the system: a worker outlives its task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``limit`` bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = utf8(b.column(b.schema.get_field_index(column)))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            yield b.slice(a, z - a)
            a = z
        del b, offs
        release()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values for a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64((seed * 0xD1B54A32D192ED03) & _MASK))


_BYTE = random_words(256, 11)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the byte spans (in order, without overlaps), the same wherever a span stands."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in blocks, so that the running sums stay small
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + HASH_BYTES, "right")))
        out[i:j] = _hash_block(data[first : ends[j - 1]], starts[i:j] - first, ends[i:j] - first)
        i = j
    return out


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(1 << max(19, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it."""
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offs[:-1][offs[:-1] < offs[1:]]
        first[at] = inside[at]
        at = offs[1:][offs[:-1] < offs[1:]] - 1
        last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive entries, one for each of the ``len(h) - k + 1`` starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(random_words(k, 29) | np.uint64(1)):
        out += h[j : j + n] * c
    return mix(out)


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts)
