"""A compressed FM-index over word numbers: suffix array, BWT in a wavelet tree of packed bits, backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros are separators; each of them differs from all others, so few rounds are needed."""
    n = len(symbols)
    separators = symbols == 0
    m = int(separators.sum())
    first = symbols.astype(np.int64) + m
    first[separators] = np.arange(m)
    _, rank = np.unique(first, return_inverse=True)
    h = 1
    while True:
        key = rank * np.int64(n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, h = new, 2 * h
        if rank[order[-1]] == n - 1 or h >= n:
            return order


class FMIndex:
    """Counts and places of word sequences in a text whose segments end with a 0."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sa = suffix_array(symbols)
        bwt = symbols[self.sa - 1].astype(np.int64)
        top = int(symbols.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels = max(1, top.bit_length())
        self.words, self.ones, self.zeros = [], [], []
        seq = bwt
        for level in range(self.levels):
            bit = (seq >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        all_symbols = np.arange(top + 1)
        self.base = self.before[:-1] - self._descend(all_symbols, np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        for level in range(self.levels):
            w = i >> 6
            mask = (one << (i & 63).astype(np.uint64)) - one
            ones = self.ones[level][w] + np.bitwise_count(self.words[level][w] & mask)
            up = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(up == 1, ones + self.zeros[level], i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with ``symbol`` and go on as those of [lo, hi)."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.base[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]


def matches(index: FMIndex, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics of the streamed text at ``starts``, cut off at ``length`` words.

    Returns the starts whose ``length`` words occur at two places or more, with their suffix intervals. The text
    is part of the index, so a search may end as soon as its interval holds one suffix only.
    """
    live = np.asarray(starts)
    symbol = text[live + length - 1]
    lo, hi = index.before[symbol], index.before[symbol + 1]
    for back in range(length - 2, -1, -1):
        many = hi - lo > 1
        live, lo, hi = live[many], lo[many], hi[many]
        if not len(live):
            break
        lo, hi = index.step(text[live + back], lo, hi)
    many = hi - lo > 1
    return live[many], lo[many], hi[many]
