"""A Merkle manifest of a table, and proofs climbed by a recursive query.

Every three consecutive nodes of a source become their parent until one is left, the source's subroot; the subroots
become the root in the same way. Levels are built ``STRIDE`` at a time: a block of ``3**STRIDE`` consecutive nodes
is one bounded group, whatever the source's size. The stored rows are the nodes at the foot of a block. Each holds the
siblings met on the way to the top of its block and the key of the row above, where the climb goes on, so a climb
takes one step for ``STRIDE`` levels. A row looked up by many leaves is stored in copies, and each leaf takes one.

Null fields are part of a leaf's hash; a null doc_id comes first in its source and is never tampered with; a null
source is a source of its own, before all others. Rows that repeat are leaves of their own; those that share a
doc_id follow each other by their hash. An empty table has an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.session import cut_lineage

FAN = 3
STRIDE = 6  # levels a stored row spans
BLOCK = FAN**STRIDE
PIECE = 10_000  # leaves that look up one copy of a stored row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOT = ""  # name of the tree over the subroots; sources are named '-' (null) or '=' and the source


@dataclass
class Manifest:
    """``leaves``: one row per row of the table; ``nodes``: all rows above them."""

    leaves: DataFrame
    nodes: DataFrame


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Lower-case hex SHA-256 of the fields: ``-`` for null, else byte count, colon and value."""
    parts = []
    for c in fields.values():
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampers(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _leaves(docs: DataFrame) -> DataFrame:
    """(tree, place, hash, doc_id, tampered): ``place`` sorts like doc_id, then hash."""
    own = {c: F.col(c) for c in FIELDS}
    changed = F.when(tampers(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_hash(own).alias("_h"), leaf_hash(own | {"text": changed}).alias("_t"))
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # sign bit turned
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("tree"),
        F.concat(F.coalesce(number, F.lit("!")), F.col("_h")).alias("place"),
        F.unhex("_h").alias("hash"),
        "doc_id",
        F.unhex("_t").alias("tampered"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds the 0-based number ``i`` by ``place`` within the tree, and the tree's number of rows ``n``.

    Rows are dealt by ranges of ``place``, so a large tree lies in many parts; counts of the parts give the rest.
    """
    placed = cut_lineage(rows.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    per = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("tree").orderBy("part"))
    per = per.select("tree", "part", (upto - F.col("c")).alias("before"), F.sum("c").over(W.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(W.partitionBy("tree", "part").orderBy("place"))
    return placed.join(per, ["tree", "part"]).withColumn("i", F.col("before") + inside - 1).drop("part", "before", "place")


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def _text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "")


def _parents(level: Column) -> Column:
    """Hashes of every three consecutive nodes of a block's level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda j: F.unhex(F.sha2(_text(F.slice(level, j * FAN + 1, FAN)), 256)))


def _tier(nodes: DataFrame, tier: int) -> DataFrame:
    """Stored rows of the nodes (tree, i, n, hash, leaves, ...), with the top of their block and its leaves.

    ``sides`` holds the siblings left and right on each level up to the block's top; a tree that has one node
    left on some level ends there.
    """
    names = [c for c in nodes.columns if c not in ("tree", "n")]
    rows = nodes.groupBy("tree", "n", F.floor(F.col("i") / BLOCK).cast("long").alias("block"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("i", *[c for c in names if c != "i"]))).alias("feet"))
    rows = rows.withColumn("l0", F.transform("feet", lambda x: x["hash"]))
    more = [_ceil_div(F.col("n"), FAN**j) > 1 for j in range(STRIDE)]
    for j in range(STRIDE):
        rows = rows.withColumn(f"l{j + 1}", F.when(more[j], _parents(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))

    def sides(p: Column) -> Column:
        each = []
        for j in range(STRIDE):
            at = F.floor(p / FAN**j).cast("int")
            in_run = at % FAN
            left, right = (F.slice(f"l{j}", at - in_run + 1, in_run), F.slice(f"l{j}", at + 2, FAN - 1 - in_run))
            each.append(F.when(more[j], F.struct(F.unhex(_text(left)).alias("l"), F.unhex(_text(right)).alias("r"))))
        return F.filter(F.array(*each), lambda s: s.isNotNull())

    feet = F.transform("feet", lambda x, p: F.struct(*[x[c].alias(c) for c in names], sides(p).alias("sides")))
    below = F.aggregate("feet", F.lit(0).cast("long"), lambda a, x: a + x["leaves"])
    return rows.select("tree", F.lit(tier).alias("tier"), "n", "block", F.col(f"l{STRIDE}")[0].alias("top"), below.alias("below"), F.inline(feet))


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All tiers of trees with up to ``most`` leaves."""
    out = [cut_lineage(_tier(nodes, 0))]
    while most > BLOCK:
        tops = out[-1].filter((F.col("n") > BLOCK) & (F.col("i") % BLOCK == 0))
        tops = tops.select("tree", F.col("block").alias("i"), _ceil_div(F.col("n"), BLOCK).alias("n"), F.col("top").alias("hash"), F.col("below").alias("leaves"))
        out.append(cut_lineage(_tier(tops, len(out))))
        most = -(-most // BLOCK)
    return out


def _linked(tier: DataFrame, t: int, ends: DataFrame | None) -> DataFrame:
    """Adds the key of the row above, null at the root; ``ends`` numbers the trees in the tree above."""
    if ends is None:
        tier = tier.withColumn("end", F.lit(None).cast("long"))
    else:  # a tree ends in at most BLOCK rows, so no key of this join is large
        last = tier.filter(F.col("n") <= BLOCK).join(ends, "tree", "left")
        tier = last.unionByName(tier.filter(F.col("n") > BLOCK).withColumn("end", F.lit(None).cast("long")))
    last = F.col("n") <= BLOCK
    return tier.select(
        *[c for c in tier.columns if c not in ("n", "block", "end")],
        F.when(~last, F.col("tree")).when(F.col("end").isNotNull(), F.lit(ROOT)).alias("up_tree"),
        F.when(last, F.lit(0)).otherwise(F.lit(t + 1)).alias("up_tier"),
        F.when(last, F.col("end")).otherwise(F.col("block")).alias("up_i"),
        _ceil_div(F.col("below"), PIECE).alias("up_pieces"),
    )


def _most(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def build(docs: DataFrame) -> Manifest:
    """The manifest of a table with the columns of ``FIELDS``; other columns are no part of it."""
    numbered = cut_lineage(_numbered(cut_lineage(_leaves(docs))).withColumn("leaves", F.lit(1).cast("long")))
    tiers = _tiers(numbered, _most(numbered))
    ends = [t.filter((F.col("n") <= BLOCK) & (F.col("i") == 0)).select("tree", "top", "below") for t in tiers]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    top = subroots.select(F.lit(ROOT).alias("tree"), F.col("tree").alias("place"), F.col("tree").alias("source"), F.col("top").alias("hash"), F.col("below").alias("leaves"))
    top = cut_lineage(_numbered(top))
    ends = top.select(F.col("source").alias("tree"), F.col("i").alias("end"))
    upper = [_linked(t, k, ends).drop("doc_id", "tampered") for k, t in enumerate(tiers) if k]
    upper += [_linked(t, k, None) for k, t in enumerate(_tiers(top.drop("source"), _most(top)))]
    nodes = upper[0]
    for u in upper[1:]:
        nodes = nodes.unionByName(u)
    return Manifest(cut_lineage(_linked(tiers[0], 0, ends)), cut_lineage(nodes))


CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT doc_id, hash AS leaf, CAST(NULL AS BINARY) AS subroot, top,
         unhex(aggregate(sides, lower(hex(tampered)), (h, s) -> sha2(concat(lower(hex(s.l)), h, lower(hex(s.r))), 256))) AS folded,
         aggregate(sides, X'', (p, s) -> concat(p, s.l, s.r)) AS proof,
         up_tree, up_tier, up_i, CAST(pmod(hash(hash), up_pieces) AS INT) AS up_copy
  FROM {{leaves}}
  UNION ALL
  SELECT c.doc_id, c.leaf, coalesce(c.subroot, CASE WHEN n.tree = '{ROOT}' THEN n.hash END), n.top,
         unhex(aggregate(n.sides, lower(hex(c.folded)), (h, s) -> sha2(concat(lower(hex(s.l)), h, lower(hex(s.r))), 256))),
         aggregate(n.sides, c.proof, (p, s) -> concat(p, s.l, s.r)),
         n.up_tree, n.up_tier, n.up_i, CAST(pmod(hash(c.leaf), n.up_pieces) AS INT)
  FROM climb c JOIN {{nodes}} n ON c.up_tree = n.tree AND c.up_tier = n.tier AND c.up_i = n.i AND c.up_copy = n.copy
)
SELECT doc_id, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, lower(hex(top)) AS root,
       sha2(lower(hex(proof)), 256) AS proof_sha256, lower(hex(folded)) AS folded_root, folded = top AS verified
FROM climb WHERE up_tree IS NULL"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def prove(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, for each leaf of the manifest.

    The siblings on the way to the root are the proof; ``folded_root`` is what they and the tampered row give. The
    recursion is as deep as the tree is high over ``STRIDE``; it runs here, without the limit on its rows.
    """
    spark = manifest.leaves.sparkSession
    copies = F.sequence(F.lit(0), (_ceil_div(F.col("leaves"), PIECE) - 1).cast("int"))
    nodes = manifest.nodes.withColumn("copy", F.explode(copies))
    limit = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return cut_lineage(spark.sql(CLIMB, leaves=manifest.leaves, nodes=nodes))
    finally:
        if limit is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, limit)


def proofs(docs: DataFrame) -> DataFrame:
    return prove(build(docs))
