"""Co-clustering of users and items (George & Merugu 2005)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions.columns import hash_number, nullif0
from affinity.operators.scale import with_row
from affinity.session import cut_lineage


class CoClusters(NamedTuple):
    """users: (user_id, g); items: (item_id, h)."""

    users: DataFrame
    items: DataFrame


def hash_clusters(ratings: DataFrame, n_user: int = 3, n_item: int = 3) -> CoClusters:
    """Starting clusters from md5, the same on every run."""
    users = ratings.select("user_id").distinct()
    items = ratings.select("item_id").distinct()
    return CoClusters(
        users.withColumn("g", (hash_number(F.col("user_id")) % n_user).cast("int")),
        items.withColumn("h", (hash_number(F.col("item_id")) % n_item).cast("int")),
    )


def _cell_offsets(rows: DataFrame, n_user: int, n_item: int) -> DataFrame:
    """(g, h, c) with c = cell mean - user cluster mean - item cluster mean: n_user * n_item rows.

    An empty cell or cluster counts as the global mean.
    """
    spark = rows.sparkSession
    cells = rows.groupBy("g", "h").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    grid = spark.range(n_user * n_item).select(
        (F.col("id") % n_user).cast("int").alias("g"), F.floor(F.col("id") / n_user).cast("int").alias("h")
    )
    cells = grid.join(F.broadcast(cells), ["g", "h"], "left").fillna({"s": 0.0, "n": 0})

    def mean(by: list[str], out: str) -> DataFrame:
        m = cells.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        return F.broadcast(m.select(*by, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias(out)))

    m = cells.select("g", "h").join(mean(["g", "h"], "a"), ["g", "h"]).join(mean(["g"], "au"), "g").join(mean(["h"], "ai"), "h")
    m = with_row(m, cells.agg((F.sum("s") / nullif0(F.sum("n"))).alias("all")))
    fill = {c: F.coalesce(F.col(c), F.col("all")) for c in ("a", "au", "ai")}
    return m.select("g", "h", (fill["a"] - fill["au"] - fill["ai"]).alias("c"))


def _with_means(ratings: DataFrame) -> DataFrame:
    """x = rating - user mean - item mean, next to the rating."""
    mu = ratings.groupBy("user_id").agg(F.avg("rating").alias("mu"))
    mi = ratings.groupBy("item_id").agg(F.avg("rating").alias("mi"))
    return (
        ratings.join(mu, "user_id")
        .join(mi, "item_id")
        .select("user_id", "item_id", "rating", (F.col("rating") - F.col("mu") - F.col("mi")).alias("x"))
    )


def _reassign(rows: DataFrame, offsets: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Best cluster per key. The squared error to each cluster follows from three sums per (key, other
    cluster), so each rating is added up once and not once per candidate."""
    st = rows.groupBy(key, other).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    # offsets is a table of n_user * n_item rows
    err = F.col("q") - 2 * F.col("c") * F.col("s") + F.col("n") * F.col("c") * F.col("c")
    fits = st.join(F.broadcast(offsets), other).groupBy(key, own).agg(F.round(F.sum(err), 9).alias("e"))
    return fits.groupBy(key).agg(F.min(F.struct("e", own)).alias("b")).select(key, F.col(f"b.{own}").alias(own))


def co_clustering(ratings: DataFrame, n_user: int = 3, n_item: int = 3, n_epochs: int = 20) -> CoClusters:
    """Alternate: users to their best cluster, then items, for a fixed number of passes."""
    rows = cut_lineage(_with_means(ratings))
    users, items = hash_clusters(rows, n_user, n_item)
    for _ in range(n_epochs):
        placed = rows.join(users, "user_id").join(items, "item_id")
        users = cut_lineage(_reassign(placed, _cell_offsets(placed, n_user, n_item), "user_id", "g", "h"))
        placed = rows.join(users, "user_id").join(items, "item_id")
        items = cut_lineage(_reassign(placed, _cell_offsets(placed, n_user, n_item), "item_id", "h", "g"))
    return CoClusters(users, items)


def co_clustering_predict(ratings: DataFrame, clusters: CoClusters, targets: DataFrame, n_user: int = 3, n_item: int = 3) -> DataFrame:
    """Cell mean plus the user's and the item's distance from their cluster mean. An unknown user gets
    the item mean, an unknown item the user mean, both unknown the global mean."""
    placed = ratings.join(clusters.users, "user_id").join(clusters.items, "item_id")
    off = F.broadcast(_cell_offsets(placed, n_user, n_item))
    mu = ratings.groupBy("user_id").agg(F.avg("rating").alias("mu"))
    mi = ratings.groupBy("item_id").agg(F.avg("rating").alias("mi"))
    g = ratings.agg(F.avg("rating").alias("_all"))
    full = (
        targets.join(clusters.users.join(mu, "user_id"), "user_id", "left")
        .join(clusters.items.join(mi, "item_id"), "item_id", "left")
        .join(off, ["g", "h"], "left")
    )
    guess = F.coalesce(F.col("c") + F.col("mu") + F.col("mi"), F.col("mu"), F.col("mi"), F.col("_all"))
    return with_row(full, g).select(*targets.columns, guess.alias("prediction"))
