"""Near duplicates by MinHash with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes); texts with one set form a
   class, stood for by its smallest doc_id. Copies meet nowhere else, so a large group costs nothing.
2. ``BANDS`` bands of ``ROWS`` MinHash values. Stars: each class is a candidate with one class of every
   bucket it is in, in ``ROUNDS`` rounds with another centre each time. Signatures are compared ``BATCH``
   values at a time and a pair is dropped once the posterior probability of a similarity of ``threshold``
   or more is below ``MISS``; of what is left each class confirms its likeliest partner on the full sets.
   Components of the confirmed links are labels. Work and links grow with the classes, not with pairs.
3. Buckets whose members still carry several labels hold all candidates that can matter. The components of
   these buckets are cut into cells of two blocks (at most ``BLOCK`` classes and ``BLOCK_SHINGLES``
   shingles each on average), so that every pair meets in one cell and no cell grows with the group. In a
   cell, pairs that share a band and differ in label go through the same batches and full sets; a cell reports
   one link for labels it brings together, none where all members are one label already.
4. Components of all confirmed links, handed back to all documents of each class.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 5e-8.

Results in odd cases: a text without words has an empty set, links with nothing and is its own
component; a text shorter than a shingle is one shingle; rows that share a doc_id count as one document
whose links are pooled; a null doc_id is never linked, has a null component and is kept; other columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.components import components
from affinity.llm.textops import LOWER, SMALL_BYTES, gram_hash, random_words, slices, span_hash, utf8, words
from affinity.session import cut_lineage

BANDS, ROWS, BATCH = 32, 4, 16
BLOCK, BLOCK_SHINGLES, CHUNK = 512, 1 << 18, 1 << 16
ROUNDS = 2
HASHES = BANDS * ROWS
MISS = 1e-7
_MULTIPLY = random_words(HASHES, 3) | np.uint64(1)
_FLIP = random_words(HASHES, 5)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the number of them before each row."""
    data = LOWER[data]
    starts, ends, at = words(data, offs)
    h = span_hash(data, starts, ends)
    grams = gram_hash(h, k)
    parts, count = [], np.zeros(len(offs) - 1, np.int64)
    for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if z - a >= k:
            own = np.unique(grams[a : z - k + 1])
        elif z > a:
            own = gram_hash(h[a:z], z - a) ^ np.uint64(z - a)
        else:
            continue
        parts.append(own)
        count[i] = len(own)
    sets = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return sets, np.concatenate([[0], np.cumsum(count)])


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Low 16 bits of the MinHash values of each row; rows with an empty set get the largest value.

    Values that differ agree in these bits with a probability of 2^-16, which can only keep a pair longer.
    """
    out = np.full((len(at) - 1, HASHES), 0xFFFF, np.uint16)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        for j in range(HASHES):
            x = (sets ^ _FLIP[j]) * _MULTIPLY[j]
            out[full, j] = np.minimum.reduceat(x, at[full]).astype(np.uint16)
    return out


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature as one 64-bit value for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SMALL_BYTES):
            sets, at = shingle_sets(*utf8(b.column("text")), k)
            n = np.diff(at)
            raw = memoryview(sets.tobytes())
            digest = [blake2b(raw[a * 8 : z * 8], digest_size=16).digest() if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            bands = signatures(sets, at).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


@lru_cache(8)
def least_matches(threshold: int, miss: float = MISS) -> tuple[int, ...]:
    """Fewest agreeing values after each batch at which a pair stays.

    With a uniform prior the posterior of the similarity after m of n agreements is Beta(m+1, n-m+1), and
    P(S >= t) = P(Binomial(n+1, t) <= m).
    """
    t, out = threshold / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def plausible(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int, other: np.ndarray | None = None) -> np.ndarray:
    """Positions of the pairs (i, j) that share a band and stay above the posterior bound in every batch.

    ``j`` counts rows of ``other`` where it is given.
    """
    kept = [np.zeros(0, np.int64)]
    right = sig if other is None else other
    for a in range(0, len(i), CHUNK):
        x, y = i[a : a + CHUNK], j[a : a + CHUNK]
        stay = np.flatnonzero((sig.view(np.int64)[x] == right.view(np.int64)[y]).any(1))
        met = np.zeros(len(stay), np.int64)
        for step, least in enumerate(least_matches(threshold)):
            s = slice(step * BATCH, (step + 1) * BATCH)
            met += (sig[x[stay], s] == right[y[stay], s]).sum(1)
            high = met >= least
            stay, met = stay[high], met[high]
        kept.append(stay + a)
    return np.concatenate(kept)


def _linked(sets: np.ndarray, at: np.ndarray, label: np.ndarray, threshold: int, stars: bool) -> list[tuple[int, int]]:
    """Rows of different labels whose sets reach the threshold (in per cent).

    ``stars``: all such pairs, of which the signatures have been compared before. Else the signatures are
    compared here, and one link is returned for labels that come together.
    """
    rows = len(at) - 1
    n = np.diff(at)
    i, j = np.triu_indices(rows, 1)
    fits = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
    i, j = i[fits], j[fits]
    if len(i) and not stars:
        left = plausible(signatures(sets, at), i, j, threshold)
        i, j = i[left], j[left]
    if not len(i):
        return []
    used = np.union1d(i, j)
    row = np.repeat(np.arange(rows), n)
    mine = np.isin(row, used)
    row, value = row[mine], sets[mine]
    _, col, df = np.unique(value, return_inverse=True, return_counts=True)
    shared = df[col] > 1
    row, col = row[shared], col[shared]
    both = np.zeros((rows, rows), np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for a in range(0, int(col[-1]) + 1, 4096):  # exact intersections, a strip of shingles at a time
            s = slice(*np.searchsorted(col, [a, a + 4096]))
            x = np.zeros((rows, 4096), np.float32)
            x[row[s], col[s] - a] = 1
            both += x @ x.T
    inter = both[i, j].astype(np.int64)
    ok = 100 * inter >= threshold * (n[i] + n[j] - inter)
    pairs = list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))
    if stars:
        return pairs
    root = np.unique(label, return_index=True, return_inverse=True)
    root = root[1][root[2]].tolist()  # the first row of the same label

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    forest = []
    for x, y in pairs:
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((x, y))
    return forest


def _stars(shared: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """(c, lead): each class with the centre of each of its buckets, if their labels differ."""
    if labels is None:
        return shared.filter("c <> lead").select("c", "lead").distinct()
    own = _labelled(shared.select("c", "band"), labels)
    centre = F.min_by(F.struct("c", "label"), F.xxhash64("c", F.lit(seed)))
    mixed = own.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), centre.alias("centre")).filter("lo < hi")
    met = own.join(mixed.select("band", "centre"), "band").filter(F.col("label") != F.col("centre.label"))
    return met.select("c", F.col("centre.c").alias("lead")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    named = rows.join(labels.select(F.col("node").alias("c"), "component"), "c", "left")
    return named.select(*rows.columns, F.coalesce("component", "c").alias("label"))


def _likeliest(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs that signatures cannot rule out, the one with most agreeing values for each class."""
    right = sigs.select(F.col("c").alias("lead"), F.col("n").alias("m"), F.col("bands").alias("others"))
    rows = pairs.join(sigs.select("c", "n", "bands").hint("merge"), "c").join(right.hint("merge"), "lead")
    rows = rows.filter(100 * F.least("n", "m") >= threshold * F.greatest("n", "m")).select("c", "lead", "n", "bands", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.ascontiguousarray(b.column(s).flatten().to_numpy(zero_copy_only=False)).reshape(-1, BANDS).view(np.uint16) for s in ("bands", "others"))
            own = np.arange(b.num_rows)
            left = plausible(x, own, own, threshold, y)
            agree = (x[left] == y[left]).sum(1)
            ids = b.select(["c", "lead", "n"]).take(pa.array(left))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(agree, pa.int64())], ["c", "lead", "n", "agree"])

    scored = rows.mapInArrow(run, "c long, lead long, n long, agree long")
    return scored.groupBy("c").agg(F.max_by("lead", F.struct("agree", "lead")).alias("lead"), F.max("n").alias("n"))


def _pieces() -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))


def _star_cells(pairs: DataFrame) -> DataFrame:
    """(node, cluster, i, j, label): the classes of a centre in pieces, the centre in each of them."""
    sizes = pairs.groupBy("lead").agg(_pieces().alias("p"))
    cell = [F.col("lead").alias("cluster"), "i", F.lit(0).cast("long").alias("j")]
    own = pairs.join(sizes, "lead").withColumn("i", F.pmod(F.xxhash64("c"), F.col("p")))
    members = own.select(F.col("c").alias("node"), *cell, F.lit(1).cast("long").alias("label"))
    return members.union(own.select(F.col("lead").alias("node"), *cell, F.lit(0).cast("long").alias("label")).distinct())


def _cells(shared: DataFrame, labels: DataFrame, sigs: DataFrame) -> DataFrame:
    """(node, cluster, i, j, label): the cells of the classes that share a bucket with another label."""
    own = _labelled(shared.select("c", "band"), labels)
    mixed = own.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    members = cut_lineage(own.join(mixed.select("band", "lo"), "band").select("c", "label", "lo").distinct())
    # labels, not classes, are tied together: a group that is one label already is one node
    tied = components(members.select("label", "lo").distinct(), "label", "lo").withColumnRenamed("node", "label")
    clusters = members.select(F.col("c").alias("node"), "label").distinct().join(tied, "label")
    clusters = clusters.join(sigs.groupBy(F.col("c").alias("node")).agg(F.max("n").alias("n")), "node")
    clusters = cut_lineage(clusters)
    sizes = cut_lineage(clusters.groupBy("component").agg(_pieces().alias("p")))
    grid = clusters.join(sizes, "component").withColumn("x", F.pmod(F.xxhash64("node"), F.col("p")))
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("p") - 1)))
    return grid.select("node", F.col("component").alias("cluster"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "label")


def _links(docs: DataFrame, cells: DataFrame, k: int, threshold: int, stars: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("node"), "text").join(cells.hint("merge"), "node")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def compare(nodes: list, labels: list, texts: list) -> tuple[list, list]:
        if len(nodes) < 2:
            return [], []
        parts = [shingle_sets(*utf8(pa.array([t], pa.string())), k)[0] for t in texts]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        pairs = _linked(np.concatenate(parts), at, np.array(labels), threshold, stars)
        return [nodes[x] for x, _ in pairs], [nodes[y] for _, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, labels, texts, a, b = None, [], [], [], [], []
        for piece in slices(batches):
            keys = list(zip(*(piece.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True))
            rows = zip(keys, *(piece.column(c).to_pylist() for c in ("node", "label", "text")), strict=True)
            for key, node, label, text in rows:
                if key != cell:
                    x, y = compare(nodes, labels, texts)
                    a += x
                    b += y
                    cell, nodes, labels, texts = key, [], [], []
                nodes.append(node)
                labels.append(label)
                texts.append(text)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        a, b = compare(nodes, labels, texts)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def confirmed_links(docs: DataFrame, sigs: DataFrame, k: int, threshold: int) -> DataFrame:
    """(a, b): links of classes, confirmed on full sets, that connect all that belongs together."""
    bands = cut_lineage(sigs.select("c", F.posexplode("bands")).select("c", F.xxhash64("pos", "col").alias("band")))
    leads = cut_lineage(bands.groupBy("band").agg(F.min("c").alias("lead"), F.max("c").alias("last")).filter("lead < last").select("band", "lead"))
    shared = cut_lineage(bands.join(leads.hint("merge"), "band"))
    links, labels = None, None
    for seed in range(ROUNDS):
        pairs = cut_lineage(_likeliest(_stars(shared, labels, seed), sigs, threshold))
        new = cut_lineage(_links(docs, cut_lineage(_star_cells(pairs)), k, threshold, stars=True))
        links = new if links is None else links.union(new)
        labels = components(links)
    return links.union(_links(docs, cut_lineage(_cells(shared, labels, sigs)), k, threshold, stars=False))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for every document."""
    prints = cut_lineage(fingerprints(docs, k))
    full = prints.filter("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct(F.col("doc_id").alias("c"), F.col("n_shingles").alias("n"), "bands"), "doc_id").alias("first")
    sigs = cut_lineage(full.groupBy("digest").agg(first).select("digest", "first.*"))
    groups = components(confirmed_links(docs, sigs, k, threshold))
    named = cut_lineage(
        sigs.join(groups, sigs.c == groups.node, "left").select("digest", F.coalesce("component", "c").alias("component_id"))
    )
    out = prints.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The documents of which each group's smallest doc_id is kept, all columns as they are."""
    gone = near_duplicates(docs, k, threshold).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(cut_lineage(gone), "doc_id", "left_anti").select(*docs.columns)
