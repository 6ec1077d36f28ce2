"""Quality: a compression classifier with two zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text. A document is cut into blocks of
``BLOCK`` bytes; each block is compressed with either dictionary, and the normalised difference of the
summed sizes, ``(bad - good) / (bad + good)``, is turned into a probability by a logistic curve fitted on
labelled rows that the dictionaries have not seen. Every byte of every text is compressed.

Results in odd cases: null and empty texts have a difference of 0 and score accordingly; without labels of
both classes every document scores the smoothed share of label 1; repeated rows give repeated rows; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.labelled import class_weights, fit_logistic, held_out, prior, training_sample
from affinity.llm.textops import slices, utf8

BLOCK = 2048
LEVEL = 3
PER_CLASS = 3000  # labelled rows of each class that the fit may use
DICTIONARY = 112 << 10  # bytes of a dictionary
TRAIN_BYTES = 4 << 20  # bytes of labelled text of each class that a dictionary is trained on
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _dictionary(texts: list[bytes]) -> bytes:
    """Blocks are taken from all texts in turn until the bound, so that no long text fills it alone."""
    blocks: list[bytes] = []
    size, at = 0, 0
    live = [t for t in texts if t]
    while live and size < TRAIN_BYTES:
        for t in live:
            if size < TRAIN_BYTES:
                blocks.append(t[at : at + BLOCK])
                size += len(blocks[-1])
        at += BLOCK
        live = [t for t in live if len(t) > at]
    if size < 64 << 10 or len(blocks) < 16:
        return b"".join(blocks)  # too little to train on: the text itself is the dictionary
    return zstandard.train_dictionary(min(DICTIONARY, size // 8), blocks, level=LEVEL).as_bytes()


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    opts = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    out = []
    for d in (model.good, model.bad):
        own = zstandard.ZstdCompressionDict(d)
        own.precompute_compress(level=LEVEL)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **opts)
        out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=params) if d else zstandard.ZstdCompressor(compression_params=params))
    return out


def _difference(data: np.ndarray, offs: np.ndarray, tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(data))
    out = np.zeros(len(offs) - 1)
    good, bad = tools[0].compress, tools[1].compress
    for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        g = b = 0
        for p in range(a, z, BLOCK):
            block = raw[p : min(z, p + BLOCK)]
            g += len(good(block))
            b += len(bad(block))
        if g + b:
            out[i] = (b - g) / (b + g)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Dictionaries from half of the sample, the curve from the other half."""
    sample, counts = training_sample(docs, labels, label, per_class)
    base = float(np.log(prior(counts) / (1 - prior(counts))))
    if not counts[0] or not counts[1]:
        return Model(b"", b"", 0.0, base)
    half = sample.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    # bounded: at most per_class rows of a class, and of each no more than a dictionary can use
    cut = F.substring("text", 1, TRAIN_BYTES // 32)
    lists = {y: [] for y in (0, 1)}
    for y in (0, 1):
        rows = half.filter((F.col("own") == 0) & (F.col("y") == y)).select("doc_id", cut.alias("t"))
        picked = rows.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(TRAIN_BYTES // BLOCK)
        lists[y] = [bytes(r.t, "utf-8", "surrogatepass") for r in picked.collect()]
    model = Model(_dictionary(lists[1]), _dictionary(lists[0]), 0.0, base)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(_difference(*utf8(b.column("text")), tools))], ["doc_id", "y", "d"])

    got = half.filter("own = 1").select("doc_id", "y", "text").mapInArrow(differ, "doc_id long, y int, d double").toPandas().sort_values("doc_id")
    if got["y"].nunique() < 2:
        return Model(b"", b"", 0.0, base)
    y = got["y"].to_numpy()
    slope, intercept = fit_logistic(got[["d"]].to_numpy(), y, class_weights(y, counts), ridge=1e-4)
    return Model(model.good, model.bad, float(slope), float(intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.3 or more) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(model)
        for b in slices(batches):
            z = model.slope * _difference(*utf8(b.column("text")), tools) + model.intercept
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
