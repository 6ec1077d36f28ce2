"""Plan shapes shared by the operators: skew-proof joins, distributed ranks and running sums.

None of them puts an unbounded group into one task, and everything they broadcast has a bound
that does not depend on the data size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Bucket = Callable[[DataFrame], DataFrame]

# A key is heavy when it makes more than 1/MAX_HEAVY of the joined rows, so there are never more
# than MAX_HEAVY heavy keys and their table can be broadcast whatever the input size.
MAX_HEAVY = 10_000
# Below this many joined rows a key is never worth splitting.
PAIR_FLOOR = 50_000_000


def heavy_keys(
    left: DataFrame, right: DataFrame | None, keys: Sequence[str], pair_floor: int = PAIR_FLOOR
) -> DataFrame | None:
    """Keys whose join output is too much for one task, with the pieces to cut each side into.

    ``right`` is None for a self-join.
    """
    keys = list(keys)
    n_l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    if right is None:
        deg = n_l.withColumn("_nr", F.col("_nl"))
    else:
        deg = n_l.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
    deg = deg.withColumn("_w", F.col("_nl").cast("double") * F.col("_nr"))
    total, top = deg.agg(F.sum("_w"), F.max("_w")).first()
    if top is None or top <= pair_floor:
        return None
    limit = max(float(pair_floor), total / MAX_HEAVY)
    side = limit**0.5
    return (
        deg.filter(F.col("_w") > limit)
        .withColumn("_pr", F.ceil(F.col("_nr") / F.lit(side)))
        .withColumn("_pl", F.ceil(F.col("_w") / (F.lit(limit) * F.col("_pr"))))
        .select(*keys, "_pl", "_pr")
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_salt: Sequence[str],
    right_salt: Sequence[str],
    pair_floor: int = PAIR_FLOOR,
    self_join: bool = False,
) -> DataFrame:
    """Inner many-to-many join in which a heavy key is cut into a grid of pieces.

    Rows of a heavy key get a piece number from their salt columns and are copied to each piece of
    the other side, so every pair meets in exactly one cell and the cells run as separate tasks.
    Light keys join as usual. The result equals the plain join. ``self_join`` says that both sides
    hold the same keys equally often, so they are counted once.
    """
    keys = list(keys)
    heavy = heavy_keys(left, None if self_join else right, keys, pair_floor)
    if heavy is None:
        return left.join(right, keys)

    def placed(df: DataFrame, own: str, own_n: str, other: str, other_n: str, salt: Sequence[str]) -> DataFrame:
        return (
            df.join(F.broadcast(heavy), keys, "left")
            .withColumn(own, F.coalesce(F.pmod(F.xxhash64(*salt), F.col(own_n)), F.lit(0)))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1)))
            .drop("_pl", "_pr")
        )

    lhs = placed(left, "_lp", "_pl", "_rp", "_pr", left_salt)
    rhs = placed(right, "_rp", "_pr", "_lp", "_pl", right_salt)
    return lhs.join(rhs, [*keys, "_lp", "_rp"]).drop("_lp", "_rp")


def hash_bucket(key: Column, buckets: int = 256) -> Column:
    """Bucket that grows with the md5 of the key, by its leading 16 bits; at most 65,536 buckets."""
    lead = F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("bigint")
    return F.floor(lead * buckets / 65536)


def range_bucket(df: DataFrame, key: str, buckets: int = 256) -> Bucket:
    """Adds a bucket number ``_b`` that grows with ``key``, balanced by a fixed number of sampled cut points.

    ``key`` must be distinct in ``df``. The cut points are the keys with the smallest md5 (a uniform
    choice of at most ``buckets - 1`` values), so this is the only data that reaches the driver. A null
    key is in bucket 0.
    """
    cuts = (
        df.select(key)
        .filter(F.col(key).isNotNull())
        .orderBy(F.md5(F.col(key).cast("string")), key)
        .limit(buckets - 1)
    )
    vals = sorted(r[0] for r in cuts.collect())
    if not vals:
        return lambda rows: rows.withColumn("_b", F.lit(0))
    arr = F.array(*[F.lit(v).cast(df.schema[key].dataType) for v in vals])

    def place(rows: DataFrame) -> DataFrame:
        # binary search: _b cut points are known to be at or below the key; one projection per halving
        rows = rows.withColumn("_b", F.lit(0))
        step = 1 << (len(vals).bit_length() - 1)
        while step:
            up = F.get(arr, F.col("_b") + (step - 1)) <= F.col(key)
            rows = rows.withColumn("_b", F.when(up, F.col("_b") + step).otherwise(F.col("_b")))
            step >>= 1
        return rows

    return place


def grouped_sums(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column | Bucket,
    order: Sequence[Column],
    sums: dict[str, Column],
    ascending: bool = True,
) -> DataFrame:
    """Running sums per group in ``order``, by bucket totals plus a window inside each bucket.

    ``bucket`` must be monotone in ``order`` (growing if ``ascending``). No task sorts more than
    one bucket of one group.
    """
    groups = list(groups)
    rows = df.withColumn("_b", bucket) if isinstance(bucket, Column) else bucket(df)
    totals = rows.groupBy(*groups, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    b = F.col("_b") if ascending else -F.col("_b")
    before = W.partitionBy(*groups).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *groups, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    # without groups the totals are one row per bucket, a bounded table
    rows = rows.join(F.broadcast(totals) if not groups else totals, [*groups, "_b"])
    inside = W.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for n, c in sums.items():
        rows = rows.withColumn(n, F.col(f"_o_{n}") + F.sum(c).over(inside))
    return rows.drop("_b", *[f"_o_{n}" for n in sums])


def grouped_index(
    df: DataFrame, groups: Sequence[str], bucket: Column | Bucket, order: Sequence[Column], out: str
) -> DataFrame:
    """0-based row number per group in ``order`` (see :func:`grouped_sums`)."""
    one = F.lit(1).cast("bigint")
    return grouped_sums(df, groups, bucket, order, {out: one}).withColumn(out, F.col(out) - 1)


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an aggregate without keys) as a scalar subquery."""
    packed = one.select(F.struct(*one.columns).alias("_s")).scalar()
    return df.withColumn("_s", packed).select("*", "_s.*").drop("_s")
