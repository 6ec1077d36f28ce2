"""Grouped and global statistics over ratings, labels and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.scale import with_row


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def count_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def global_mean_positive(ratings: DataFrame) -> DataFrame:
    """Sum, count and mean over ratings above zero."""
    r = F.when(F.col("rating") > 0, F.col("rating"))
    return ratings.agg(
        F.sum(r).alias("rating_sum"),
        F.count(r).alias("n_ratings"),
        F.avg(r).alias("global_mean"),
    )


def matrix_shape(ratings: DataFrame) -> DataFrame:
    """Users, items, ratings, density."""
    shape = ratings.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_ratings"),
    )
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return shape.withColumn("density", F.when(cells > 0, F.col("n_ratings") / cells))


def item_means_zero_filled(ratings: DataFrame) -> DataFrame:
    """(item_id, item_mean): mean over all users with a missing rating as 0; the global mean of the
    positive ratings where that is not above 0."""
    totals = ratings.agg(
        F.count_distinct("user_id").alias("n_users"),
        F.avg(F.when(F.col("rating") > 0, F.col("rating"))).alias("g"),
    )
    sums = ratings.groupBy("item_id").agg(F.sum("rating").alias("s"))
    mean = F.col("s") / F.col("n_users")
    return with_row(sums, totals).select(
        "item_id", F.when(mean > 0, mean).otherwise(F.col("g")).alias("item_mean")
    )


def rating_histogram(ratings: DataFrame, col: str = "rating") -> DataFrame:
    return ratings.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def value_histogram(df: DataFrame, col: str, lo: float, width: float) -> DataFrame:
    """Equal-width bins of a continuous column: bin number and count."""
    b = F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("bigint")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def best_by_metric(runs: DataFrame, model: str, metric: str, run: str) -> DataFrame:
    """Lowest value of the metric per model and the run that had it (smallest run on ties)."""
    best = F.min(F.struct(F.col(metric), F.col(run)))
    return runs.groupBy(model).agg(best.alias("_b")).select(
        model, F.col(f"_b.{metric}").alias(f"best_{metric}"), F.col(f"_b.{run}").alias(f"best_{run}")
    )


def rank_runs(runs: DataFrame, metric: str, *params: str) -> DataFrame:
    """Grid results, best first; ties by parameters."""
    return runs.orderBy(F.col(metric).asc_nulls_last(), *params)


def lr_curve(runs: DataFrame, param: str, metric: str) -> DataFrame:
    """Mean metric per parameter value."""
    return runs.groupBy(param).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_runs"))
