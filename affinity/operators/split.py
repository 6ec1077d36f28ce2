"""Splits, folds and samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions.columns import hash_number
from affinity.operators.scale import grouped_index, hash_bucket, with_row

STEP = 4096  # tries generated, and then numbered, per piece of a user


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 17) -> list[DataFrame]:
    """Weighted random split; weights are normalised."""
    return df.randomSplit(list(weights), seed)


def hash_split(df: DataFrame, keys: Sequence[str], pct: int, out: str = "is_test") -> DataFrame:
    """0/1 column, 1 for about pct percent of the keys; the same rows on every run."""
    return df.withColumn(out, (hash_number(*[F.col(k) for k in keys]) % 100 < pct).cast("int"))


def kfold_assign(df: DataFrame, keys: Sequence[str], k: int = 10, out: str = "fold") -> DataFrame:
    return df.withColumn(out, (hash_number(*[F.col(c) for c in keys]) % k).cast("int"))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 17) -> DataFrame:
    """Bernoulli sample."""
    return df.sample(False, fraction, seed)


def balanced_class_sample(df: DataFrame, label: str, key: str, n: int = 5000, seed: int = 17) -> DataFrame:
    """n rows per class drawn with replacement. ``key`` is unique and orders the rows of a class.

    Ranks are drawn per class and matched to the row numbers of that class; the numbers come from
    per-bucket counts, so a class with most of the rows is not sorted in one task.
    """
    rows = grouped_index(df, [label], hash_bucket(F.col(key)), [F.md5(F.col(key).cast("string")), F.col(key)], "_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # 48 bits of md5 instead of a generator: a task that runs again draws the same ranks
    text = F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"), F.col("draw").cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    draws = draws.select(label, "draw", F.floor(u * F.col("_size")).cast("bigint").alias("_rank"))
    return draws.join(rows, [label, "_rank"]).drop("_rank")


def downsample_negatives(df: DataFrame, label: str, key: str, ratio: float = 1.0) -> DataFrame:
    """All rows with label 1, and the first ratio * |positives| rows with label 0 in md5 order of ``key``."""
    md5 = F.md5(F.col(key).cast("string"))
    neg = grouped_index(df.filter(F.col(label) == 0), [], hash_bucket(F.col(key)), [md5, F.col(key)], "_i")
    pos = df.filter(F.col(label) == 1)
    quota = pos.agg((F.count(F.lit(1)) * F.lit(ratio)).alias("_quota"))
    neg = with_row(neg, quota).filter("_i < _quota").drop("_i", "_quota")
    return pos.unionByName(neg)


def coprime_step(n: int) -> int:
    """Smallest step from 0.618 n up that shares no divisor with n: walking by it visits every index."""
    s = max(1, math.floor(0.618 * n))
    while math.gcd(s, n) != 1:
        s += 1
    return s


def negative_sample(ratings: DataFrame, items: DataFrame | None = None, like: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id): per user as many unrated items as rated ones, fewer only if none are left.

    With ``like`` as many as the user has items there, say in a held-out part of the ratings. Each user walks the
    item index from a hash-given start by a step that visits every item once, so as many tries as items rated
    and wanted together always suffice and no item repeats. Tries are made in pieces of STEP, so a
    user who rated a large share of the items is spread over many tasks.
    ``items`` is an (item_id, idx) map with dense idx; made from the ratings when not given.
    Ratings, tries and items meet in merge joins: the size of compressed files, or of pieces before they are opened, says
    little about the hash table that a broadcast would put on the driver. For the same reason the pieces keep the number
    of partitions they are dealt to.
    """
    if items is None:
        ids = ratings.select("item_id").distinct()
        items = grouped_index(ids, [], hash_bucket(F.col("item_id")), [F.md5(F.col("item_id").cast("string")), F.col("item_id")], "idx")
    n_items = items.count()
    if n_items == 0:
        return ratings.select("user_id", "item_id").limit(0)
    step = coprime_step(n_items)
    users = ratings.groupBy("user_id").agg(F.count_distinct("item_id").alias("_p"))
    users = users.withColumn("_m", 2 * F.col("_p"))
    if like is not None:
        wanted = like.groupBy("user_id").agg(F.count_distinct("item_id").alias("_w"))
        users = users.join(wanted, "user_id").select("user_id", F.col("_w").alias("_p"), (F.col("_p") + F.col("_w")).alias("_m"))
    users = users.withColumn("_m", F.least(F.lit(n_items).cast("bigint"), "_m"))
    pieces = users.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1, F.lit(STEP).cast("bigint"))))
    n_parts = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tries = pieces.repartition(n_parts, "user_id", "_lo").select(
        "user_id",
        "_p",
        F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + STEP, F.col("_m")) - 1)).alias("_t"),
    )
    start = hash_number(F.col("user_id")) % n_items
    tries = tries.withColumn("idx", (start + F.col("_t") * step) % n_items)
    unrated = tries.join(items.hint("merge"), "idx").join(ratings.select("user_id", "item_id").hint("merge"), ["user_id", "item_id"], "left_anti")
    ranked = grouped_index(unrated, ["user_id"], F.floor(F.col("_t") / STEP), [F.col("_t")], "_i")
    return ranked.filter("_i < _p").select("user_id", "item_id")


def train_test(df: DataFrame, keys: Sequence[str], pct: int) -> tuple[DataFrame, DataFrame]:
    marked = hash_split(df, keys, pct, "_test")
    return marked.filter("_test = 0").drop("_test"), marked.filter("_test = 1").drop("_test")


def fold_column(keys: Sequence[str], k: int) -> Column:
    return (hash_number(*[F.col(c) for c in keys]) % k).cast("int")
