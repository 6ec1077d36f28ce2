"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Where a token of the pre-tokeniser begins is decided by a small automaton over character classes.
Each character is a transition function; functions compose associatively, so all states come from a
blocked prefix scan over an array of function numbers, with no regular expression. The automaton
recognises the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Distinct slices are merged once per worker and kept in a bounded cache; all unknown slices of a text
slice are merged together, one merge of every slice per step. Offsets of the ids are kept, so a
document's text, and any run of ids, can be cut out of the decoded bytes.

Results in odd cases: a null text counts as empty and has no ids; repeated rows give repeated results;
an empty table gives an empty one; other columns are kept by ``encode`` and ``decode`` (those called
like their own output are replaced).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.textops import SMALL_BYTES, runs, slices, span_hash, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_SLOTS = 1 << 18  # distinct slices kept per worker before the cache starts afresh
LONG_SLICE = 256  # bytes; longer slices are merged one by one with a heap

# Characters: letter, number, other, white space inside a run, last of a run (not ' '), last of a run
# (' '), apostrophe before a one-letter and before a two-letter ending. Numbers 8-15: the same at a row's start.
LETTER, NUMBER, OTHER, WHITE, WHITE_LAST, SPACE_LAST, SHORT, LONG = range(8)
# States: a token must begin, in letters, in numbers, in others, in white space, after a space that
# belongs to what follows, one and two characters of a contraction to come.
BEGIN, IN_L, IN_N, IN_O, IN_W, JOINED, LEFT1, LEFT2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at the character."""
    if state in (LEFT1, LEFT2):
        return (LEFT1 if state == LEFT2 else BEGIN), False
    if symbol == WHITE:
        return IN_W, state != IN_W
    if symbol == WHITE_LAST:
        return BEGIN, True
    if symbol == SPACE_LAST:
        return JOINED, True
    if symbol in (LETTER, NUMBER):
        own = IN_L if symbol == LETTER else IN_N
        return own, state not in (own, JOINED)
    if state in (IN_O, JOINED):
        return IN_O, False
    return {OTHER: IN_O, SHORT: LEFT1, LONG: LEFT2}[symbol], True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol, composition table, state table and begin table."""
    table = [[_step(s, x) for s in range(8)] for x in range(8)]
    single = [tuple(t[0] for t in row) for row in table]
    single += [(f[BEGIN],) * 8 for f in single]
    number = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    for f in todo:
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    states = np.array(list(number), np.uint8)
    then = states[np.arange(len(states))[None, :, None], states[:, None, :]]  # then[f, g] = g after f
    key = {f: i for f, i in number.items()}
    compose = np.array([[key[tuple(map(int, x))] for x in row] for row in then], np.uint16)
    begins = np.array([[t[1] for t in row] for row in table] + [[row[BEGIN][1]] * 8 for row in table], bool)
    return np.array([number[f] for f in single], np.uint16), compose, states, begins


def _prefix(f: np.ndarray, compose: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive scan of function numbers: blocks side by side, then the blocks' totals in the same way."""
    n = len(f)
    if n <= block:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, f.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat, m = compose.ravel(), len(compose)
    for i in range(1, block):
        grid[i] = flat[grid[i - 1].astype(np.int32) * m + grid[i]]
    before = np.zeros(rows, f.dtype)
    before[1:] = _prefix(np.ascontiguousarray(grid[-1]), compose, block)[:-1]
    whole = flat[before.astype(np.int32)[None, :] * m + grid]
    return np.ascontiguousarray(whole.T).ravel()[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, other or white space."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # fixed values: Unicode's White_Space
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return out


def boundaries(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which the pre-tokeniser's tokens of all rows begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offs)] = True
    white = kind == WHITE
    ends = np.ones(n, bool)  # white space that is followed by more of it, or by the row's end
    ends[:-1] = white[1:] | first[1:-1]
    kind = np.where(white & ~ends, np.where(points == 0x20, SPACE_LAST, WHITE_LAST), kind)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        ahead = np.full((2, len(quote)), 0, np.uint32)
        ok = (quote + 1 < n) & ~first[np.minimum(quote + 1, n)]
        ahead[0, ok] = points[quote[ok] + 1]
        ok &= (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        ahead[1, ok] = points[quote[ok] + 2]
        kind[quote[np.isin(ahead[0], [ord(c) for c in "stmd"])]] = SHORT
        two = ahead[0].astype(np.int64) << 21 | ahead[1]
        kind[quote[np.isin(two, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    symbol = kind + np.uint8(8) * first[:-1]
    single, compose, states, begins = _automaton()
    after = states[_prefix(single[symbol], compose), BEGIN]
    before = np.zeros(n, np.uint8)
    before[1:] = after[:-1]
    return lead[begins[symbol, before]]


class Vocabulary:
    """Ranks of a byte-level BPE, the merges they allow and the bytes of each id."""

    def __init__(self, lines: list[bytes]):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for t, r in self.ranks.items():
            by_id[r] = t
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, to = [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    to.append(r)
        order = np.argsort(keys)
        self.pairs, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.none = np.int32(2**31 - 1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.to[at], self.none)

    def merge(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each slice: the lowest-ranked, leftmost pair is merged until none is left."""
        out: list[np.ndarray] = [None] * len(parts)  # type: ignore[list-item]
        waiting: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG_SLICE:
                out[i] = self._merge_long(p)
            else:
                waiting.setdefault(-(-len(p) // 8), []).append(i)
        for eights, at in waiting.items():
            step = (1 << 16) // eights  # slices of a block, so that every block has the same size
            for a in range(0, len(at), step):
                self._merge_block([parts[i] for i in at[a : a + step]], eights * 8, at[a : a + step], out)
        return out

    def _merge_block(self, parts: list[bytes], width: int, where: list[int], out: list) -> None:
        n = np.array([len(p) for p in parts])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
        ids = self.single[raw]
        ids[np.arange(width)[None, :] >= n[:, None]] = -1
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], 1)
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(parts))
        final = ids.copy()
        where_col = np.arange(width + 1)
        while len(rows):
            pos = rank.argmin(1)
            low = rank[np.arange(len(rows)), pos]
            done = low == self.none
            if done.any():
                final[rows[done]] = ids[done]
                keep = ~done
                rows, ids, rank, pos, low = rows[keep], ids[keep], rank[keep], pos[keep], low[keep]
                if not len(rows):
                    break
            src = np.minimum(where_col[None, :] + (where_col[None, :] > pos[:, None]), width)
            ids = np.take_along_axis(ids, src, 1)
            ids[:, -1] = -1
            me = np.arange(len(rows))
            ids[me, pos] = low
            rank = np.take_along_axis(rank, np.minimum(src[:, :-1], width - 1), 1)
            rank[:, -1] = self.none
            rank[me, pos] = self.pair_rank(ids[me, pos], ids[me, pos + 1])
            left = pos > 0
            rank[me[left], pos[left] - 1] = self.pair_rank(ids[me[left], pos[left] - 1], ids[me[left], pos[left]])
        count = (final >= 0).sum(1)
        for i, w in enumerate(where):
            out[w] = final[i, : count[i]]

    def _merge_long(self, part: bytes) -> np.ndarray:
        n = len(part)
        ids = [int(self.single[b]) for b in part]
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = lambda a, b: self.ranks.get(self.piece(ids[a]) + self.piece(ids[b]))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := pair(x, y)) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([ids[i] for i in range(n) if live[i]], np.int32)

    def piece(self, i: int) -> bytes:
        return self.bytes[self.begin[i] : self.begin[i] + self.lengths[i]].tobytes()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the byte offset at which each id's bytes begin."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(int(n.sum()))], ends - n


class Encoder:
    """Encodes slices of a text column; keeps the ids of the slices it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begin = self.count = np.zeros(0, np.int64)

    def _add(self, parts: list[bytes]) -> None:
        if not parts:
            return
        merged = self.v.merge(parts)
        n = np.array([len(ids) for ids in merged])
        self.slot.update(zip(parts, range(len(self.slot), len(self.slot) + len(parts)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.flat = np.concatenate([self.flat, *merged])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and for each row the number of ids before it."""
        starts = boundaries(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        _, at, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_SLOTS:
            self._reset()
        whole = data.tobytes()
        parts = [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        self._add([p for p in parts if p not in self.slot])
        slot = np.fromiter((self.slot[p] for p in parts), np.int64, len(parts))
        begin, count = self.begin[slot], self.count[slot]
        n = count[which]
        ids = self.flat[np.repeat(begin[which], n) + runs(n)]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, before[np.searchsorted(starts, offs)]


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.readlines())


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """A rank file of the installed tokenizer package, or any path; each worker reads its own copy."""
    return _vocabulary(name if "/" in name else public_tokenizers.path(name))


def _keep(df: DataFrame, own: set[str], need: str) -> list[str]:
    return [c for c in df.columns if c not in own and c != need]


def encode(df: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Adds ``ids`` (array of int) and ``starts`` (byte offset of each id in the text) to a table with ``text``."""
    keep = _keep(df, {"ids", "starts"}, "text")
    schema = df.select(*keep, "text", F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<int>").alias("starts")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(vocabulary(name))
        for b in slices(batches, limit=SMALL_BYTES):
            data, offs = utf8(b.column("text"))
            ids, at = e.encode(data, offs)
            n = e.v.lengths[ids]
            begin = np.cumsum(n) - n - np.repeat(offs[:-1], np.diff(at))
            cols = [
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, begin)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "ids", "starts"])

    return df.select(*keep, "text").mapInArrow(run, schema)


def decode(df: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded`` (binary: ids need not be whole characters) to a table with ``ids``; null ids give no bytes."""
    keep = _keep(df, {"decoded"}, "ids")
    schema = df.select(*keep, "ids", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                rows = [np.array(x.as_py() or [], np.int64) for x in b.column("ids")]
                out = [v.decode(x)[0].tobytes() for x in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return df.select(*keep, "ids").mapInArrow(run, schema)


def _round_trip(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple]:
    e = Encoder(vocabulary(name))
    for b in slices(batches, limit=SMALL_BYTES):
        data, offs = utf8(b.column("text"))
        ids, at = e.encode(data, offs)
        back, begin = e.v.decode(ids)
        begin = np.append(begin, len(back))[at]
        yield b, ids.astype("<u4").tobytes(), at, back.tobytes(), begin


def digests(df: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda raw, at: [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]
        for b, ids, at, back, begin in _round_trip(batches, name):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at)), pa.array(sha(memoryview(ids), (at * 4).tolist())), pa.array(sha(memoryview(back), begin.tolist()))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
