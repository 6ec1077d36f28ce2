"""The given tables, and the ratings / metadata / review views the recommendation operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators.scale import split_join

LIST_PART = 32  # a metadata list row never carries more elements than this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _rating() -> F.Column:
    return (1 + F.sum(F.col("l_quantity").cast("bigint")) % 5).cast("double").alias("rating")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): customers rating parts."""
    return (
        _order_lines(spark, sf_dir)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(_rating())
    )


def brand_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating): customers rating brands, a dense matrix with few items."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 10).cast("bigint").alias("item_id")
    )
    return (
        _order_lines(spark, sf_dir)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), "item_id")
        .agg(_rating())
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows with string ids, as a review export has them."""
    r = ratings(spark, sf_dir)
    return r.select(
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("reviewerID"),
        F.concat(F.lit("B"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("asin"),
        F.col("rating").alias("overall"),
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): labelled texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def _item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("view", "purchase"))
        .select(
            "user_id",
            "event_type",
            "ts",
            F.get_json_object("props", "$.k").cast("bigint").alias("item"),
        )
    )


def viewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (item, other): items viewed by a user who viewed the other one."""
    views = (
        _item_events(spark, sf_dir).filter("event_type = 'view'").select("user_id", "item").distinct()
    )
    other = views.withColumnRenamed("item", "other")
    return (
        split_join(views, other, ["user_id"], ["item"], ["other"], self_join=True)
        .filter("item <> other")
        .select("item", "other")
        .distinct()
    )


def bought_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (item, other): other was bought by a user after they viewed item."""
    ev = _item_events(spark, sf_dir)
    first_view = (
        ev.filter("event_type = 'view'").groupBy("user_id", "item").agg(F.min("ts").alias("first_view"))
    )
    last_buy = (
        ev.filter("event_type = 'purchase'")
        .groupBy("user_id", F.col("item").alias("other"))
        .agg(F.max("ts").alias("last_buy"))
    )
    return (
        split_join(first_view, last_buy, ["user_id"], ["item"], ["other"])
        .filter("last_buy > first_view AND item <> other")
        .select("item", "other")
        .distinct()
    )


def _list_rows(pairs: DataFrame, name: str) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.col("other").cast("string"), F.lit("'"))
    listed = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(quoted)), ", "), F.lit("]"))
    return (
        pairs.groupBy("item", F.floor(F.col("other") / LIST_PART).alias("part"))
        .agg(listed.alias(name))
        .drop("part")
    )


def item_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, price, brand) as strings; some values are missing, by rule."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice").cast("string")).alias("price"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("brand"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product metadata with list columns kept as text: ``"['4', '17']"``.

    An item has several rows, each with one bounded slice of its lists, so no list grows with the data.
    """
    viewed = _list_rows(viewed_pairs(spark, sf_dir), "also_viewed").withColumn(
        "buy_after_viewing", F.lit(None).cast("string")
    )
    bought = _list_rows(bought_pairs(spark, sf_dir), "buy_after_viewing").withColumn(
        "also_viewed", F.lit(None).cast("string")
    )
    return (
        viewed.unionByName(bought)
        .join(item_attributes(spark, sf_dir), "item", "left")
        .select(F.col("item").cast("string").alias("asin"), "price", "brand", "also_viewed", "buy_after_viewing")
    )
