"""Document fingerprints by randomised edit embedding.

All texts are walked with the same random steps: at time j a character c stays for one more time step with
probability a half, decided by a hash of (j, c); the walk writes down the time at which each character is
left. Two texts that differ by few edits fall into step again soon after each edit, so their edit
distance becomes a Hamming distance of what is written. The fingerprint samples that embedding: each
(time, character) falls into one of ``CELLS`` cells by its hash, and a cell keeps ``BITS`` bits of its
smallest hash. Equal texts have equal fingerprints, and the share of equal cells estimates how much of the
two walks agrees; chance agreement is taken off.

For pairs, bands of sampled cells give buckets, and candidates are verified on the whole fingerprints.

Results in odd cases: null counts as empty; an empty text has the fingerprint of no characters, and two
empty texts have a likeness of 1; repeated rows give equal results; texts of one table that share a doc_id are
ordered by their text; a null doc_id sorts last; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.components import components
from affinity.llm.textops import mix, random_words, runs, slices, utf8
from affinity.session import cut_lineage

CELLS, BITS = 256, 8
PERIOD = 1 << 16  # the random steps repeat after so many times; what is written still tells times apart
CLASSES = 256  # characters share steps by a hash of their code point
BANDS, BAND_CELLS = 32, 4
_CLASS = random_words(4096, 51)


@lru_cache(1)
def _leave() -> np.ndarray:
    """leave[c, t]: steps after t, counted from time t, until class c is left (1 at least)."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    stop = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8).astype(bool)
    stop[:, -1] = True
    times = np.where(stop, np.arange(PERIOD), PERIOD)
    nxt = np.minimum.accumulate(times[:, ::-1], 1)[:, ::-1]
    return (nxt - np.arange(PERIOD) + 1).astype(np.uint8).ravel()


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and the number of them before each row."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.searchsorted(lead, offs)


def walk(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Time at which each character is left; all rows are walked side by side, the longest for the longest time."""
    leave = _leave()
    kind = ((_CLASS[points & 0xFFF] >> np.uint64(40)).astype(np.int64) + (points >> np.uint32(12))) % CLASSES * PERIOD
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, n = at[:-1][order], n[order]
    out = np.zeros(len(points), np.int64)
    time = np.zeros(len(order), np.int64)
    alive = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), "right")
    for i, m in enumerate(alive.tolist()):
        pos = begin[:m] + i
        t = time[:m]
        t += leave[kind[pos] + (t & (PERIOD - 1))]
        out[pos] = t
    return out


def fingerprints(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, CELLS) array of the sampled embedding."""
    rows = len(at) - 1
    h = mix(walk(points, at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _CLASS[points & 0xFFF] + (points >> np.uint32(12)).astype(np.uint64))
    cell = np.repeat(np.arange(rows), np.diff(at)) * CELLS + (h >> np.uint64(56)).astype(np.int64)
    least = np.full(rows * CELLS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, cell, (h >> np.uint64(20)).astype(np.uint32))
    return mix(least.astype(np.uint64)).astype(np.uint8).reshape(rows, CELLS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal cells less chance agreement, 0 to 1."""
    chance = 1 / (1 << BITS)
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint (hex) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            points, at = characters(*utf8(b.column("text")))
            prints = fingerprints(points, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array([p.tobytes().hex() for p in prints])], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def near(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and component_id: texts linked where a bucket's smallest member verifies at ``threshold``.

    Equal fingerprints are one class; each class is compared with the first class of each of its buckets, so a
    bucket gives as many candidates as it has members.
    """
    prints = cut_lineage(fingerprint(docs))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("c")).filter("c is not null"))
    sample = np.random.Generator(np.random.PCG64(7)).permutation(CELLS)[: BANDS * BAND_CELLS].reshape(BANDS, BAND_CELLS)
    key = F.array(*[F.xxhash64(F.lit(i), *[F.substring("fingerprint", int(2 * c) + 1, 2) for c in cells]) for i, cells in enumerate(sample)])
    bands = cut_lineage(classes.select("c", F.explode(key).alias("band")))
    lead = cut_lineage(bands.groupBy("band").agg(F.min("c").alias("lead"), F.max("c").alias("last")).filter("lead < last").select("band", "lead"))
    pairs = bands.join(lead, "band").filter("c <> lead").select("c", "lead").distinct()
    pairs = pairs.join(classes, "c").join(classes.select(F.col("c").alias("lead"), F.col("fingerprint").alias("other")), "lead")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(bytes.fromhex("".join(b.column(c).to_pylist())), np.uint8).reshape(-1, CELLS) for c in ("fingerprint", "other"))
                ok = pa.array(likeness(x, y) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column("c").filter(ok), b.column("lead").filter(ok)], ["a", "b"])

    links = pairs.mapInArrow(verify, "a long, b long")
    named = classes.join(components(links), F.col("c") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "c").alias("component_id"))
    return prints.join(cut_lineage(named), "fingerprint", "left").select("doc_id", "component_id")


def _ordered(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, ahead): the rows in ranges of falling doc_id, each range with a copy of its follower.

    Cut points come from a quantile sketch, one for each partition; the follower of a range is the first row
    of the next range that has rows, and of the last range the very first row.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))}, reverse=True)
    if not cuts:
        cuts = [0]
    falling = F.array(*[F.lit(c).cast("long") for c in cuts])
    # number of cut points above the id; null ids come after all others
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(falling, lambda c: c > F.col("doc_id"))))
    rows = rows.withColumn("part", part)
    order = F.struct((-F.col("doc_id")).alias("o"), F.col("text"))
    present = rows.groupBy("part").agg(F.max("doc_id").alias("first")).orderBy("part").collect()  # one row for each range
    if not present:
        return rows.withColumn("ahead", F.lit(False))
    links = [(p["part"], p["first"], present[i - 1]["part"]) for i, p in enumerate(present)]
    firsts = spark.createDataFrame(links, "part int, first long, to int")
    heads = rows.join(F.broadcast(firsts), "part").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    # several rows may share the first id: the one that stands first is the smallest text
    heads = heads.groupBy("part", "to").agg(F.min(order).alias("h")).select(F.col("to").alias("part"), (-F.col("h.o")).alias("doc_id"), F.col("h.text").alias("text"), F.lit(True).alias("ahead"))
    return rows.withColumn("ahead", F.lit(False)).unionByName(heads)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last third (rounded down) replaced by as many characters, or all, from the start of
    the next document in falling doc_id order; after the last comes the first. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = _ordered(docs).repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices that begin with the last row of the slice before."""
        held = None
        for b in slices(batches, limit=1 << 20):
            yield b if held is None else pa.concat_batches([held, b])
            held = b.slice(b.num_rows - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            part, ahead = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "ahead"))
            points, at = characters(*utf8(b.column("text")))
            n = np.diff(at)
            own = np.flatnonzero((part[:-1] == part[1:]) & ~ahead[:-1])  # rows whose follower is here
            if not len(own):
                continue
            cut = n[own] // 3
            take = np.minimum(cut, n[own + 1])
            keep = n[own] - cut
            count = keep + take
            edge = np.concatenate([[0], np.cumsum(count)])
            first = runs(keep) + np.repeat(at[own], keep)
            second = runs(take) + np.repeat(at[own + 1], take)
            source = np.empty(int(edge[-1]), np.int64)
            source[np.repeat(edge[:-1], keep) + runs(keep)] = first
            source[np.repeat(edge[:-1] + keep, take) + runs(take)] = second
            changed = points[source]
            # one walk for the texts and the edited texts together
            prints = fingerprints(np.concatenate([points, changed]), np.concatenate([at, at[-1] + edge[1:]]))
            mine, follow, new = prints[own], prints[own + 1], prints[len(n) :]
            raw = changed.tobytes()
            sha = [hashlib.sha256(raw[4 * x : 4 * y].decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            text = lambda rows: pa.array([p.tobytes().hex() for p in rows])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(own)), pa.array(n[own]), pa.array(sha), text(mine), text(new), pa.array(likeness(mine, new)), pa.array(likeness(mine, follow))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.select("part", "ahead", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
