"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of the text with A-Z lower-cased, present or not. Over the training sample
its ratio is ``r = log((p + a)/(|p| + 2a)) - log((q + a)/(|q| + 2a))``, p and q being the numbers of
toxic and other documents that hold it. The n-grams with the largest chi-square statistic are kept, at
most ``FEATURES``; a logistic regression with an L2 penalty weighs the ratios of those present. Every n-gram
of every whole text is looked at when scoring.

Results in odd cases: null and empty texts have no features and score the intercept; without labels of
both classes every document scores the smoothed share of label 1; a null doc_id is scored like any
other; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.labelled import class_weights, held_out, prior, training_sample
from affinity.llm.textops import SMALL_BYTES, gram_hash, random_words, slices, utf8

GRAMS = (4, 6, 8)
BITS = 22
PER_CLASS = 4000  # labelled rows of each class that the fit may use
FEATURES = 4096
MIN_DOCS = 5  # training documents a feature must occur in
SMOOTH = 1.0


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # hashed n-grams in use, ascending
    weight: np.ndarray
    intercept: float
    grams: tuple[int, ...] = GRAMS


_POINT = random_words(1 << 12, 41)


def _characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each character (A-Z lower-cased), and the number of characters before each row."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points + np.uint32(32) * ((points >= 65) & (points <= 90)).astype(np.uint32)
    h = _POINT[points & 0xFFF]
    high = points > 0xFFF
    if high.any():
        h[high] += (points[high] >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h, np.searchsorted(lead, offs)


def _grams(
    data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], table: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hashed n-gram) pairs; with ``table``, only of n-grams marked there."""
    h, at = _characters(data, offs)
    rows, found = [], []
    for n in sizes:
        g = (gram_hash(h, n) >> np.uint64(64 - BITS)).astype(np.int64)
        pos = np.arange(len(g)) if table is None else np.flatnonzero(table[g])
        row = np.searchsorted(at, pos, "right") - 1
        inside = pos + n <= at[row + 1]
        rows.append(row[inside])
        found.append(g[pos[inside]])
    key = np.unique(np.concatenate(rows) << BITS | np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_class: int = PER_CLASS,
    features: int = FEATURES,
    grams: tuple[int, ...] = GRAMS,
) -> Model:
    """Counts and selection run as Spark jobs over the sample; the fit sees at most ``features`` columns."""
    sample, counts = training_sample(docs, labels, label, per_class)
    base = float(np.log(prior(counts) / (1 - prior(counts))))
    none = Model(np.zeros(0, np.int64), np.zeros(0), base, grams)
    if not counts[0] or not counts[1]:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for b in slices(batches, limit=SMALL_BYTES):
            y = b.column("y").to_numpy(zero_copy_only=False)
            row, g = _grams(*utf8(b.column("text")), grams)
            for c in (0, 1):
                own, n = np.unique(g[y[row] == c], return_counts=True)
                total[c, own] += n.astype(np.int32)
        seen = np.flatnonzero(total.any(0))
        for a in range(0, len(seen), 1 << 16):
            s = seen[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(total[0, s]), pa.array(total[1, s])], ["g", "q", "p"])

    table = sample.select("text", "y").mapInArrow(count, "g long, q int, p int").groupBy("g").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    n1, n0 = (int(min(per_class, counts[y])) for y in (1, 0))
    p, q, a = F.col("p"), F.col("q"), F.lit(SMOOTH)
    n, both = F.lit(float(n0 + n1)), p + q
    ratio = F.log((p + a) / F.lit(n1 + 2 * SMOOTH)) - F.log((q + a) / F.lit(n0 + 2 * SMOOTH))
    gap = p * F.lit(float(n0)) - q * F.lit(float(n1))
    chi = n * gap * gap / (F.lit(float(n0) * n1) * both * F.greatest(n - both, F.lit(1.0)))
    rows = (
        table.filter(both >= MIN_DOCS)
        .select("g", ratio.alias("r"), chi.alias("x"))
        .orderBy(F.desc("x"), "g")
        .limit(features)
        .collect()
    )
    if not rows:
        return none
    rows.sort(key=lambda r: r[0])
    index, r = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        mark[index] = True
        for b in slices(batches, limit=SMALL_BYTES):
            row, g = _grams(*utf8(b.column("text")), grams, mark)
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            cols = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.searchsorted(index, g).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), cols], ["doc_id", "y", "f"])

    got = sample.mapInArrow(held, "doc_id long, y int, f array<int>").toPandas().sort_values("doc_id")
    return Model(index, *_regress(index, r, got, counts), grams)


def _regress(index: np.ndarray, r: np.ndarray, got: pd.DataFrame, counts: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weights of the ratio-scaled features: logistic loss, L2 penalty, accelerated gradient steps."""
    y = got["y"].to_numpy()
    w = class_weights(y, counts)
    n = got["f"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(y)), n)
    col = np.concatenate([*map(np.asarray, got["f"]), np.zeros(0, int)]).astype(np.int64)
    value = r[col]
    beta, b = np.zeros(len(index)), float(np.log(prior(counts) / (1 - prior(counts))))
    look, look_b, ridge = beta.copy(), b, 1.0
    size = np.bincount(doc, value * value, len(y)).max(initial=1.0) + 1
    rate = 1.0 / (0.25 * size * np.sqrt(len(y)) + ridge)
    rate_b, momentum = 4.0 / max(1.0, w.sum()), 0.95
    for _ in range(400):
        z = np.bincount(doc, value * look[col], len(y)) + look_b
        e = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        step = np.bincount(col, value * e[doc], len(index)) + ridge * look
        new, new_b = look - rate * step, look_b - rate_b * 0.1 * e.sum()
        look, look_b = new + momentum * (new - beta), new_b + momentum * (new_b - b)
        beta, b = new, new_b
    return beta * r, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        mark[model.index] = True
        for b in slices(batches, limit=SMALL_BYTES):
            row, g = _grams(*utf8(b.column("text")), model.grams, mark)
            z = np.bincount(row, model.weight[np.searchsorted(model.index, g)], b.num_rows) + model.intercept
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, bool)
        mark[model.index] = True
        for b in slices(batches, limit=SMALL_BYTES):
            row, g = _grams(*utf8(b.column("text")), model.grams, mark)
            z = np.bincount(row, model.weight[np.searchsorted(model.index, g)], b.num_rows) + model.intercept
            yield b.filter(pa.array(z < 0))

    return docs.mapInArrow(run, docs.schema)
