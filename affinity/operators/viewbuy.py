"""From product metadata to a labelled, encoded table of viewed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.clean import explode_list_column, fill_null_const, with_flag
from affinity.operators.encode import label_encode
from affinity.operators.joins import view_buy_left_join
from affinity.session import cut_lineage

FEATURES = ("item_id_int", "user_also_view_int", "brand_int", "price")
LABEL = "user_buy_after_viewing_bool"
NO_BRAND = "No Brand"


def view_buy_pairs(metadata: DataFrame) -> DataFrame:
    """(item_id, price, brand, user_also_view, user_buy_after_viewing), one row per viewed pair."""
    meta = metadata.withColumnRenamed("asin", "item_id")
    viewed = explode_list_column(meta, "also_viewed", ["item_id", "price", "brand"], "user_also_view").distinct()
    bought = explode_list_column(meta, "buy_after_viewing", ["item_id"], "user_buy_after_viewing")
    return view_buy_left_join(viewed, bought)


def view_buy_dataset(metadata: DataFrame) -> DataFrame:
    """Label, brand filled, item / viewed item / brand encoded, price as a number."""
    pairs = with_flag(view_buy_pairs(metadata), "user_buy_after_viewing", LABEL)
    pairs = fill_null_const(pairs, "brand", NO_BRAND)
    pairs = pairs.select("item_id", "brand", F.expr("try_cast(price AS double)").alias("price"), "user_also_view", LABEL)
    # three code maps and the final join read the pairs, so they are written once
    return label_encode(
        cut_lineage(pairs), {"item_id": "item_id_int", "user_also_view": "user_also_view_int", "brand": "brand_int"}
    )
