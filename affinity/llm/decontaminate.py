"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks, in DataFrame functions only.

Words are what white space separates in the lower-cased text; a shingle is ``SHINGLE`` words, weighted by
``ln(1 + N / df)`` over the N benchmark items (a shingle of no item weighs ``ln(1 + N)``). The similarity of a
window and an item is the weighted Jaccard of their shingle multisets.

1. Of each item the rarest shingles are probes, until they hold more than a fifth of its weight: a window at
   0.8 or more lacks at most a fifth, so it has one of them. Fingerprinting every window of every item
   size would be some forty SimHashes a word; of the windows of the item's size all those are taken that
   hold a probe, wherever it lies in them, and no others can be at 0.8.
2. Each window and each item gets a 64-bit SimHash. They are joined on ``RADIUS + 1`` blocks of the
   fingerprint: two fingerprints within the radius agree on a block, so none of them is missed.
3. Candidates within the radius are verified by the exact similarity.

At a similarity of exactly 0.8 a Hamming distance above the radius has a probability of 2e-4. Shingle
tables are broadcast only if a count shows at most ``BROADCAST_ROWS`` rows; beyond that the same joins run
as shuffles.

Results in odd cases: null and short texts (under five words) match nothing; items of under five words are
ignored; equal items each match; rows that share a doc_id are one document; a null doc_id matches nothing
and is kept; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.session import cut_lineage

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 20
BROADCAST_ROWS = 1_000_000


def _shingles(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sh): hashes of the shingles in order; texts of under five words are left out."""
    clean = F.btrim(F.lower("text"), F.lit(" \t\n\x0b\f\r"))
    words = df.select(*keys, F.split(clean, "[ \t-\r]+").alias("w")).filter(F.size("w") >= SHINGLE)
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(SHINGLE)])
    )
    return words.select(*keys, grams.alias("sh"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _simhash(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, weight, f) of rows (keys, h, c, wt)."""
    mass = F.col("c") * F.col("wt")
    bits = [
        # rounded: a balanced bit must not depend on the order of the summands
        F.when(F.round(F.sum(F.when(F.getbit("h", F.lit(b)) == 1, mass).otherwise(-mass)), 6) > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(
            F.lit(0).cast("bigint")
        )
        for b in range(64)
    ]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return weighted.groupBy(*keys).agg(F.sum(mass).alias("weight"), total.alias("f"))


def _blocks(df: DataFrame) -> DataFrame:
    """One row for each block of the fingerprint ``f``: block number and bits."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("bits"))
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    return df.withColumn("b", F.explode(F.array(*parts))).select("*", "b.*").drop("b")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each (document, item) found."""
    items = cut_lineage(_shingles(benchmark.select("item_id", "text").distinct(), ["item_id", "text"]).drop("text"))
    n_items = float(items.count())
    rows = items.select("item_id", F.size("sh").alias("size"), F.posexplode("sh").alias("ipos", "h"))
    counts = rows.groupBy("item_id", "size", "h").agg(F.count(F.lit(1)).alias("c"), F.min("ipos").alias("ipos"))
    df = counts.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    grams = cut_lineage(counts.join(df, "h").withColumn("wt", F.log1p(F.lit(n_items) / F.col("df"))))
    n_grams = grams.count()
    per_item, rare = W.partitionBy("item_id"), W.partitionBy("item_id").orderBy("df", "ipos")
    mass = F.col("c") * F.col("wt")
    before = F.sum(mass).over(rare.rowsBetween(W.unboundedPreceding, W.currentRow)) - mass
    share = F.sum(mass).over(per_item) * F.lit(1 - THRESHOLD)
    # a little beyond the bound, for rounding
    first = grams.withColumn("b", before).withColumn("s", share).filter(F.col("b") <= F.col("s") + 1e-9).select("item_id", "h")
    probes = cut_lineage(rows.join(first, ["item_id", "h"]).select("item_id", "size", "h").distinct())

    own = docs.select("doc_id", "text").filter("doc_id is not null")
    # outer: the inner form adds filters on the array, which put the split of the text inside the loop over its words
    places = _shingles(own, ["doc_id"]).select("doc_id", F.posexplode_outer("sh").alias("pos", "h"))
    met = places.join(_small(probes, probes.count()), "h")
    # every window of the item's size that holds the probe
    starts = F.sequence(F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0)), F.col("pos"))
    hits = met.select("doc_id", "item_id", "size", F.explode(starts).alias("start")).distinct()
    by_doc = cut_lineage(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "size", "start")).alias("hits")))

    n_docs = by_doc.count()
    found = _shingles(own.join(_small(by_doc, n_docs) if n_docs <= BROADCAST_ROWS // 10 else by_doc, "doc_id"), ["doc_id", "hits"])
    found = found.withColumn("i", F.explode("hits"))
    found = found.select(
        "doc_id", "i.item_id", "i.start", "i.size", F.expr("slice(sh, i.start + 1, i.size)").alias("part")
    ).filter(F.size("part") > 0)
    # rows that share a doc_id are one document: of equal windows one counts, of others each is tried
    found = found.withColumn("own", F.hash("part")).dropDuplicates(["doc_id", "item_id", "start", "size", "own"])
    keys = ["doc_id", "item_id", "start", "size", "own"]
    parts = found.select(*keys, F.explode("part").alias("h")).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("c"))
    weights = grams.select("h", "wt").distinct()
    parts = parts.join(_small(weights, n_grams), "h", "left")
    parts = cut_lineage(parts.withColumn("wt", F.coalesce("wt", F.log1p(F.lit(n_items)))))

    windows = cut_lineage(_simhash(parts, keys))
    prints = _simhash(grams, ["item_id"]).select("item_id", F.col("f").alias("g"), F.col("weight").alias("item_weight"))
    blocks = _blocks(prints.withColumn("f", F.col("g"))).select("item_id", "block", "bits", "g", "item_weight")
    near = _blocks(windows).join(_small(blocks, n_grams), ["item_id", "block", "bits"])
    near = near.withColumn("hamming", F.bit_count(F.col("f").bitwiseXOR(F.col("g")))).filter(F.col("hamming") <= RADIUS)
    near = near.select(*keys, "weight", "item_weight", "hamming").distinct()

    other = grams.select("item_id", "h", F.col("c").alias("ic"))
    shared = parts.join(near, keys).join(_small(other, n_grams), ["item_id", "h"])
    both = F.sum(F.least("c", "ic") * F.col("wt"))
    exact = shared.groupBy(*keys, "weight", "item_weight", "hamming").agg(both.alias("both"))
    exact = exact.withColumn("similarity", F.round(F.col("both") / (F.col("weight") + F.col("item_weight") - F.col("both")), 6))
    best = F.max(F.struct("similarity", -F.col("start"), "size", "hamming")).alias("m")
    top = exact.filter(F.col("similarity") >= THRESHOLD).groupBy("doc_id", "item_id").agg(best)
    return top.select(
        "doc_id",
        "item_id",
        (-F.col("m.col2")).alias("start_word"),
        (F.col("m.size") + (SHINGLE - 1)).alias("n_words"),
        "m.hamming",
        "m.similarity",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark item, all columns as they are."""
    bad = cut_lineage(contaminated(docs, benchmark).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
