"""LM scoring by masked pseudo-likelihood with a bidirectional window network in numpy.

Every word is predicted from ``REACH`` words on both sides; a document's score is the sum of these
conditional log-probabilities. The vocabulary is the most frequent words of the whole corpus, counted by a
shuffle; other words fall into ``RARE`` hash buckets. The output layer has two levels (class, then word in
its class), so that a prediction costs the square root of the vocabulary.

Training is data-parallel: in each of ``ROUNDS`` rounds every task runs Adagrad over its part of the corpus from
the common model, at every ``ROUNDS``-th word of every document (the next ones in each round, so that after the last
round each word has been a target once), and the models are averaged by the number of words seen, in a tree of groups. What reaches the driver is one model
of fixed size, whatever the corpus; what is gathered for it grows with the corpus.

Results in odd cases: null and empty texts have no words and score 0; repeated rows give equal scores; a
null doc_id is scored like any other; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.textops import LOWER, slices, span_hash, utf8, words

SIDE = 64  # classes, and words of a class
WORDS, RARE = SIDE * SIDE - 64, 64
DIM, REACH, BATCH = 24, 2, 4096
PIECE = 2048  # targets worked on at once
ROUNDS, RATE = 2, 0.1
_OFFSETS = np.array([o for o in range(-REACH, REACH + 1) if o])
PAD = SIDE * SIDE


@dataclass
class Network:
    """Word vectors, a weight for each context place, and the two output layers."""

    e: np.ndarray
    p: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    m: np.ndarray
    mb: np.ndarray

    @classmethod
    def start(cls, seed: int = 17) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        z = lambda *s: np.zeros(s, np.float32)
        return cls(f(PAD + 1, DIM), np.ones((len(_OFFSETS), DIM), np.float32), f(DIM, SIDE), z(SIDE), f(SIDE, DIM, SIDE), z(SIDE, SIDE))

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.p, self.c, self.cb, self.m, self.mb]

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in cls.start().arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return cls(*out)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _hidden(net: Network, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = net.e.take(ctx, 0)
    z = e[:, 0] * net.p[0]
    for o in range(1, len(net.p)):
        z += e[:, o] * net.p[o]
    return e, np.tanh(z, out=z)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of targets by class, and the stretch of each class in it (the classes that occur)."""
    kind = (y // SIDE).astype(np.uint8)  # small integers are sorted in linear time
    edge = [0, *np.cumsum(np.bincount(kind, minlength=SIDE)).tolist()]
    return np.argsort(kind, kind="stable"), [(k, slice(edge[k], edge[k + 1])) for k in range(SIDE) if edge[k] < edge[k + 1]]


def _picked(z: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at one column; ``z`` is used up."""
    z -= z.max(1, keepdims=True)
    own = np.exp(z[np.arange(len(z)), col])
    np.exp(z, out=z)
    return np.log(own / z.sum(1) + 1e-30)


def _word_level(net: Network, h: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
    """Scores of the words of each row's class; rows come by class."""
    z = np.empty((len(h), SIDE), np.float32)
    for k, at in parts:
        np.add(h[at] @ net.m[k], net.mb[k], out=z[at])
    return z


def log_prob(net: Network, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context."""
    order, parts = _by_class(y)
    y = y.take(order)
    _, h = _hidden(net, ctx.take(order, 0))
    out = np.empty(len(y))
    out[order] = _picked(h @ net.c + net.cb, y // SIDE).astype(np.float64) + _picked(_word_level(net, h, parts), y % SIDE)
    return out


def train_step(net: Network, seen: list[np.ndarray], ctx: np.ndarray, y: np.ndarray) -> None:
    """One Adagrad step on a batch; ``seen`` holds the sums of squared gradients.

    The gradient is added up over pieces of the batch, whose arrays stay in the processor's cache.
    """
    b = len(y)
    order, parts = _by_class(y)
    ctx, y = ctx.take(order, 0), y.take(order)
    kind, word = y // SIDE, y % SIDE
    dz = np.empty((b, DIM), np.float32)
    gp, gc, gcb, gm, gmb = (np.zeros_like(a) for a in net.arrays()[1:])
    for lo in range(0, b, PIECE):
        hi = min(b, lo + PIECE)
        here = [(k, slice(max(at.start, lo) - lo, min(at.stop, hi) - lo)) for k, at in parts if at.start < hi and at.stop > lo]
        row = np.arange(hi - lo)
        e, h = _hidden(net, ctx[lo:hi])
        pc = _softmax(h @ net.c + net.cb)
        pc[row, kind[lo:hi]] -= 1
        q = _softmax(_word_level(net, h, here))
        q[row, word[lo:hi]] -= 1
        dh = pc @ net.c.T
        for k, at in here:
            gm[k] += h[at].T @ q[at]
            gmb[k] += q[at].sum(0)
            dh[at] += q[at] @ net.m[k].T
        gc += h.T @ pc
        gcb += pc.sum(0)
        np.multiply(dh, 1 - h * h, out=dz[lo:hi])
        gp += np.einsum("bod,bd->od", e, dz[lo:hi])
    flat = ctx.ravel()
    order = np.argsort(flat, kind="stable")
    ids = flat.take(order)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ids = ids[first]
    places = len(net.p)
    around = dz.take(order // places, 0)
    around *= net.p.take(order % places, 0)
    ge = np.add.reduceat(around, first)
    for a, s, g in zip(net.arrays()[1:], seen[1:], [gp, gc, gcb, gm, gmb], strict=True):
        g /= b
        s += g * g
        a -= RATE * g / (np.sqrt(s) + 1e-6)
    ge /= b
    seen[0][ids] += ge * ge
    net.e[ids] -= RATE * ge / (np.sqrt(seen[0][ids]) + 1e-6)


def _first_not_below(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What ``np.searchsorted(known, h)`` finds; the leading 16 bits lead to a handful of hashes."""
    lead = np.searchsorted(known, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
    place = lead[(h >> np.uint64(48)).astype(np.int64)]
    last = np.append(known, np.uint64((1 << 64) - 1))
    for _ in range(int(np.diff(lead, append=len(known)).max())):
        place += last[place] < h
    return place


def _ids(data: np.ndarray, offs: np.ndarray, known: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows (``known``: ascending hashes, ``number``: their numbers) and the words before each row."""
    data = LOWER[data]
    s, e, at = words(data, offs)
    h = span_hash(data, s, e)
    out = (WORDS + (h % np.uint64(RARE))).astype(np.int64)
    if len(known):
        place = np.minimum(_first_not_below(known, h), len(known) - 1)
        hit = known[place] == h
        out[hit] = number[place[hit]]
    return out, at


def _padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with REACH empty places around each row, and the place of each word among them."""
    place = np.arange(len(ids)) + REACH * np.repeat(np.arange(1, len(at)), np.diff(at))
    out = np.full(len(ids) + REACH * len(at), PAD, np.int16)
    out[place] = ids
    return out, place


def _keep_freed_memory() -> None:
    """The allocator keeps freed blocks up to twice the largest it has seen freed; a step's arrays are then not mapped afresh each time."""
    np.empty(31 << 20, np.uint8)


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of all documents, most frequent first (ties: smaller hash)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n, size = [], [], 0

        def merged() -> pa.RecordBatch:
            h, n = np.concatenate(held_h), np.concatenate(held_n)
            u, which = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(which, n).astype(np.int64))], ["h", "n"])

        for b in slices(batches):
            data, offs = utf8(b.column("text"))
            data = LOWER[data]
            s, e, _ = words(data, offs)
            u, n = np.unique(span_hash(data, s, e), return_counts=True)
            held_h.append(u)
            held_n.append(n)
            size += len(u)
            if size > 1 << 21:
                yield merged()
                held_h, held_n, size = [], [], 0
        if held_h:
            yield merged()

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(WORDS).collect()  # a vocabulary of fixed size
    return np.array([r[0] for r in top], np.int64).view(np.uint64)


def _train_round(docs: DataFrame, known: np.ndarray, number: np.ndarray, model: np.ndarray, turn: int) -> np.ndarray:
    blocks = 16

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed_memory()
        net = Network.unpack(model)
        seen = [np.full_like(a, 1e-4) for a in net.arrays()]
        n, held_c, held_y, size, mark = 0, [], [], 0, 0
        for b in slices(batches):
            data, offs = utf8(b.column("text"))
            ids, at = _ids(data, offs, known, number)
            pos = np.arange(len(ids))
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pick = (pos - at[row]) % ROUNDS == turn
            padded, place = _padded(ids, at)
            held_c.append(padded[place[pick][:, None] + _OFFSETS])
            held_y.append(ids[pick])
            size += len(held_y[-1])
            mark = (mark * 31 + int(offs[-1])) % 64  # spreads the tasks over the first level of the tree
            if size >= BATCH:
                c, y = np.concatenate(held_c), np.concatenate(held_y)
                full = size - size % BATCH
                for a in range(0, full, BATCH):
                    train_step(net, seen, c[a : a + BATCH], y[a : a + BATCH])
                held_c, held_y, size = [c[full:]], [y[full:]], size - full
                n += full
        if size:
            train_step(net, seen, np.concatenate(held_c), np.concatenate(held_y))
            n += size
        if n:
            flat = net.pack()
            parts = np.array_split(flat, blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(blocks), pa.int32()), pa.array([mark] * blocks, pa.int32()), pa.array([float(n)] * blocks), pa.array([x.tobytes() for x in parts], pa.binary())],
                ["block", "branch", "n", "values"],
            )

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = rows["n"].sum()
        x = sum(np.frombuffer(v, np.float32) * (n / total) for v, n in zip(rows["values"], rows["n"], strict=True))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "n": [total], "values": [x.astype(np.float32).tobytes()]})

    schema = "block int, n double, values binary"
    local = docs.select("text").mapInArrow(train, "block int, branch int, n double, values binary")
    middle = local.groupBy("block", "branch").applyInPandas(mean, schema)
    rows = middle.groupBy("block").applyInPandas(mean, schema).collect()  # one model
    if not rows:
        return model
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["block"])])


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending word hashes, their numbers, and the packed network."""
    top = vocabulary(docs)
    order = np.argsort(top)
    known, number = top[order], order.astype(np.int64)
    model = Network.start().pack()
    for r in range(ROUNDS):
        model = _train_round(docs, known, number, model, r)
    return known, number, model


def score(docs: DataFrame, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all words) and mean_log_likelihood (0 without words)."""
    known, number, model = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed_memory()
        net = Network.unpack(model)
        for b in slices(batches):
            ids, at = _ids(*utf8(b.column("text")), known, number)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            padded, place = _padded(ids, at)
            found = np.empty(len(ids))
            for a in range(0, len(ids), PIECE):
                part = slice(a, a + PIECE)
                found[part] = log_prob(net, padded[place[part, None] + _OFFSETS], ids[part])
            total = np.bincount(row, found, len(at) - 1).astype(float)  # whole numbers where no row has a word
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
