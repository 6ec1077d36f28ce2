"""View/buy joins, user x item products, metadata merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.scale import grouped_sums, range_bucket
from affinity.session import cut_lineage

CHUNK = 1024  # items per chunk of the user x item product


def view_buy_left_join(viewed: DataFrame, bought: DataFrame) -> DataFrame:
    """viewed(item_id, user_also_view, ...) left join bought(item_id, user_buy_after_viewing) on both keys."""
    b = bought.select("item_id", "user_buy_after_viewing").distinct()
    b = b.withColumn("user_also_view", F.col("user_buy_after_viewing"))
    return viewed.join(b, ["item_id", "user_also_view"], "left")


def _bought_keys(bought: DataFrame) -> DataFrame:
    return bought.select("item_id", F.col("user_buy_after_viewing").alias("user_also_view"))


def viewed_and_bought(viewed: DataFrame, bought: DataFrame) -> DataFrame:
    return viewed.join(_bought_keys(bought), ["item_id", "user_also_view"], "left_semi")


def viewed_not_bought(viewed: DataFrame, bought: DataFrame) -> DataFrame:
    return viewed.join(_bought_keys(bought), ["item_id", "user_also_view"], "left_anti")


def merge_metadata(df: DataFrame, meta: DataFrame, key: str = "asin") -> DataFrame:
    """Left merge; ``meta`` has one row per key."""
    return df.join(meta, key, "left")


def pos_neg_pairs(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Per user, every positive prediction against every negative one, in counted form.

    (user_id, prediction, n_pos, n_neg, n_wins): n_pos positives of the user have this prediction, each
    is paired with n_neg negatives and beats n_wins of them. The product itself is never emitted:
    wins are a running count over the distinct scores of a user, taken range by range.
    """
    both = pos.select("user_id", "prediction", F.lit(1).alias("_p"), F.lit(0).alias("_n")).unionByName(
        neg.select("user_id", "prediction", F.lit(0).alias("_p"), F.lit(1).alias("_n"))
    )
    # three passes go over this table; the predictions are made for it once
    per_score = cut_lineage(
        both.groupBy("user_id", "prediction").agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("_negs"))
    )
    scores = per_score.select("prediction").distinct()
    bucket = range_bucket(scores, "prediction", 64)
    ranked = grouped_sums(
        per_score, ["user_id"], bucket, [F.col("prediction")], {"_upto": F.col("_negs")}
    )
    totals = per_score.groupBy("user_id").agg(F.sum("_negs").alias("n_neg")).filter("n_neg > 0")
    return (
        ranked.filter("n_pos > 0")
        .join(totals, "user_id")
        .select("user_id", "prediction", "n_pos", "n_neg", (F.col("_upto") - F.col("_negs")).alias("n_wins"))
    )


def counts_left_outer(pairs: DataFrame) -> DataFrame:
    """Per user: pairs in all and pairs won, 0 where none was won. One aggregate instead of a join."""
    return pairs.groupBy("user_id").agg(
        F.sum(F.col("n_pos") * F.col("n_neg")).alias("total"),
        F.sum(F.col("n_pos") * F.col("n_wins")).alias("correct"),
    )


def anti_testset(ratings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every (user_id, item_id) that is not rated.

    Items are cut into chunks of about ``chunk`` ids; a user is paired with chunks, not items, and the
    rated ids of that chunk are taken away from the chunk's array. So the shuffle carries one row per
    (user, chunk) and no array is longer than a chunk.
    """
    items = ratings.select("item_id").distinct()
    n_items = items.count()
    n_chunks = max(1, -(-n_items // chunk))
    chunk_of = F.pmod(F.xxhash64("item_id"), F.lit(n_chunks)).alias("chunk")
    chunks = items.groupBy(chunk_of).agg(F.collect_list("item_id").alias("ids"))
    rated = ratings.groupBy("user_id", chunk_of).agg(F.collect_set("item_id").alias("rated"))
    grid = (
        ratings.select("user_id")
        .distinct()
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))))
    )
    grid = grid.join(chunks, "chunk")  # a broadcast while the chunk table is small, which the runtime decides
    left = grid.join(rated, ["user_id", "chunk"], "left")
    unrated = F.array_except("ids", F.coalesce("rated", F.array().cast("array<bigint>")))
    return left.select("user_id", F.explode(unrated).alias("item_id"))


def coalesce_default(df: DataFrame, cols: Sequence[str], value: float) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in cols})
