"""Item-item similarity from ratings in long form (item_i < item_j; see :func:`mirror`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.functions.columns import nullif0
from affinity.operators.scale import PAIR_FLOOR, split_join, with_row

LIST_WIDTH = 1024  # item ids per slice of a similarity list


def transpose(triples: DataFrame) -> DataFrame:
    """Swap the roles of user and item; the triples are the matrix."""
    return triples.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")


def corated_pairs(ratings: DataFrame, pair_floor: int = PAIR_FLOOR) -> DataFrame:
    """Sums over the users who rated both items of a pair: n, si, sj, qi, qj, dot.

    Products are added up where the join makes them (map-side aggregation in the join's own stage), so
    what is shuffled grows with the distinct pairs. Users with very many ratings are cut into a grid
    of pieces (:func:`split_join`); nobody's ratings are left out.
    """
    a = ratings.select("user_id", F.col("item_id").alias("item_i"), F.col("rating").alias("ri"))
    b = ratings.select("user_id", F.col("item_id").alias("item_j"), F.col("rating").alias("rj"))
    both = split_join(a, b, ["user_id"], ["item_i"], ["item_j"], pair_floor, self_join=True)
    return (
        both.filter("item_i < item_j")
        .groupBy("item_i", "item_j")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("ri").alias("si"),
            F.sum("rj").alias("sj"),
            F.sum(F.col("ri") * F.col("ri")).alias("qi"),
            F.sum(F.col("rj") * F.col("rj")).alias("qj"),
            F.sum(F.col("ri") * F.col("rj")).alias("dot"),
        )
    )


def _item_sums(ratings: DataFrame, side: str) -> DataFrame:
    return ratings.groupBy(F.col("item_id").alias(f"item_{side}")).agg(
        F.sum("rating").alias(f"t{side}"), F.sum(F.col("rating") * F.col("rating")).alias(f"u{side}")
    )


def pearson(n: Column, dot: Column, si: Column, sj: Column, qi: Column, qj: Column) -> Column:
    """Pearson from sums; null when one side does not vary."""
    var = (n * qi - si * si) * (n * qj - sj * sj)
    return (n * dot - si * sj) / F.sqrt(F.when(var > 0, var))


def item_pearson_zero_filled(ratings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pearson over all users with a missing rating as 0.

    By default for the pairs some user rated both of. Any other pair has dot = 0 and so a negative
    value; give ``pairs`` (item_i, item_j) to get stated pairs, those included.
    """
    dots = corated_pairs(ratings).select("item_i", "item_j", "n", "dot")
    if pairs is not None:
        dots = pairs.join(dots, ["item_i", "item_j"], "left").fillna({"n": 0, "dot": 0.0})
    users = ratings.agg(F.count_distinct("user_id").cast("double").alias("m"))
    full = dots.join(_item_sums(ratings, "i"), "item_i").join(_item_sums(ratings, "j"), "item_j")
    full = with_row(full, users)
    c = F.col
    return full.select("item_i", "item_j", "n", pearson(c("m"), c("dot"), c("ti"), c("tj"), c("ui"), c("uj")).alias("sim"))


def item_pearson_corated(ratings: DataFrame) -> DataFrame:
    """Pearson over the users who rated both; two of them at least."""
    c = F.col
    p = corated_pairs(ratings).filter("n >= 2")
    sim = pearson(c("n").cast("double"), c("dot"), c("si"), c("sj"), c("qi"), c("qj"))
    return p.select("item_i", "item_j", "n", sim.alias("sim"))


def item_cosine_corated(ratings: DataFrame) -> DataFrame:
    """Cosine over the users who rated both."""
    p = corated_pairs(ratings)
    return p.select("item_i", "item_j", "n", (F.col("dot") / nullif0(F.sqrt(F.col("qi") * F.col("qj")))).alias("sim"))


def item_pearson_baseline(residuals: DataFrame, shrinkage: float = 100.0) -> DataFrame:
    """Shrunk correlation of baseline residuals (Koren 2010); ``residuals`` has the residual as rating."""
    p = corated_pairs(residuals)
    rho = F.col("dot") / nullif0(F.sqrt(F.col("qi") * F.col("qj")))
    damp = (F.col("n") - 1) / (F.col("n") - 1 + F.lit(shrinkage))
    return p.select("item_i", "item_j", "n", (rho * damp).alias("sim"))


def mirror(sims: DataFrame) -> DataFrame:
    """Both directions of every pair, from one pass over the pairs."""
    there = F.struct(F.col("item_i"), F.col("item_j"), F.col("sim"))
    back = F.struct(F.col("item_j").alias("item_i"), F.col("item_i").alias("item_j"), F.col("sim"))
    return sims.select(F.inline(F.array(there, back)))


def similarity_lists(sims: DataFrame, width: int = LIST_WIDTH) -> DataFrame:
    """Per item its similarity row, in slices of ``width`` item ids: (item_i, part, entries)."""
    part = F.floor(F.col("item_j") / width).alias("part")
    entries = F.array_sort(F.collect_list(F.struct("item_j", "sim"))).alias("entries")
    return mirror(sims).groupBy("item_i", part).agg(entries)


def top_k_neighbors(sims: DataFrame, k: int) -> DataFrame:
    """k most similar items per item; each map task keeps its best k before the shuffle."""
    w = W.partitionBy("item_i").orderBy(F.col("sim").desc(), "item_j")
    both = mirror(sims).filter(F.col("sim").isNotNull())
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def row_argmax(sims: DataFrame) -> DataFrame:
    """The most similar other item per item (smallest id on ties)."""
    both = mirror(sims).filter(F.col("sim").isNotNull())
    best = F.max(F.struct("sim", (-F.col("item_j")).alias("neg"))).alias("b")
    return both.groupBy("item_i").agg(best).select("item_i", (-F.col("b.neg")).alias("item_j"), F.col("b.sim").alias("sim"))


def neighbors_sorted(sims: DataFrame, item: int) -> DataFrame:
    """One item's similarities, highest first."""
    return mirror(sims).filter(F.col("item_i") == item).orderBy(F.col("sim").desc_nulls_last(), "item_j")
