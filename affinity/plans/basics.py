"""Queries over sources, cleaning, ids, joins, aggregates, order, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import columns as C
from affinity.operators import aggregates as A
from affinity.operators import clean as K
from affinity.operators import encode as E
from affinity.operators import joins as J
from affinity.operators import split as S
from affinity.plans.registry import BRAND, RATINGS, REVIEWS, TEXTS, VIEWBUY, query, r6, s6
from affinity.session import cut_lineage
from affinity.sources import readers as R
from affinity.sources import tables as T
from affinity.sources import writers as Wr

# ---------------------------------------------------------------- sources and sinks (round trips)

DOC_REVIEWS = """SELECT 'R' || CAST(doc_id AS VARCHAR) AS "reviewerID", source AS asin,
  CAST(n_chars % 5 + 1 AS DOUBLE) AS overall, md5(text) AS text_md5 FROM documents"""


def _doc_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select(
        F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("reviewerID"),
        F.col("source").alias("asin"),
        (F.col("n_chars") % 5 + 1).cast("double").alias("overall"),
        F.col("text").alias("reviewText"),
    )


def _with_md5(df: DataFrame) -> DataFrame:
    return df.select("reviewerID", "asin", "overall", F.md5("reviewText").alias("text_md5"))


@query("read_reviews_json", DOC_REVIEWS)
def read_reviews_json(spark, sf):
    path = Wr.scratch_dir(spark)
    _doc_reviews(spark, sf).write.json(path)
    return _with_md5(R.read_reviews_json(spark, path))


@query("read_loose_json", DOC_REVIEWS)
def read_loose_json(spark, sf):
    """Documents written as Python dict literals, gz, then read back."""
    path = Wr.scratch_dir(spark)

    def literal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": [repr(d) for d in pdf.to_dict("records")]})

    _doc_reviews(spark, sf).mapInPandas(literal, "value string").write.option("compression", "gzip").text(path)
    return _with_md5(R.read_loose_json(spark, path).filter(f"{R.CORRUPT} IS NULL"))


RATINGS_CSV = f"""WITH {REVIEWS} SELECT "reviewerID" AS user_id_str, asin AS item_id_str,
  CASE WHEN overall <> 3 THEN overall END AS rating FROM reviews"""


def _ratings_csv(spark, sf, header: bool, *extra):
    path = Wr.scratch_dir(spark)
    rating = F.when(F.col("overall") != 3, F.col("overall").cast("string")).otherwise("?")
    T.reviews(spark, sf).select(
        F.col("reviewerID").alias("user_id_str"), F.col("asin").alias("item_id_str"), rating.alias("rating"), *extra
    ).write.option("header", header).csv(path)
    return path


@query("read_ratings_csv", RATINGS_CSV)
def read_ratings_csv(spark, sf):
    return R.read_ratings_csv(spark, _ratings_csv(spark, sf, True))


@query("read_ratings_csv_noheader", RATINGS_CSV)
def read_ratings_csv_noheader(spark, sf):
    return R.read_ratings_csv_noheader(spark, _ratings_csv(spark, sf, False, F.lit(0).alias("time_stamp")))


@query(
    "read_metadata_csv",
    f"""WITH {VIEWBUY}, lists AS (
      SELECT item, also_viewed, CAST(NULL AS VARCHAR) AS buy_after_viewing FROM (
        SELECT item, '[' || string_agg('''' || CAST(other AS VARCHAR) || '''', ', ' ORDER BY CAST(other AS VARCHAR)) || ']' AS also_viewed
        FROM viewed GROUP BY item, other // {T.LIST_PART})
      UNION ALL
      SELECT item, NULL, l FROM (
        SELECT item, '[' || string_agg('''' || CAST(other AS VARCHAR) || '''', ', ' ORDER BY CAST(other AS VARCHAR)) || ']' AS l
        FROM bought GROUP BY item, other // {T.LIST_PART}))
    SELECT CAST(item AS VARCHAR) AS asin, CAST(price AS VARCHAR) AS price, brand, also_viewed, buy_after_viewing
    FROM lists LEFT JOIN attrs USING (item)""",
)
def read_metadata_csv(spark, sf):
    path = Wr.scratch_dir(spark)
    Wr.write_csv(T.metadata(spark, sf), path)
    return R.read_metadata_csv(spark, path)


@query(
    "read_text_lines",
    "SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY line",
)
def read_text_lines(spark, sf):
    path = Wr.scratch_dir(spark)
    T.table(spark, sf, "conversations").select("text").write.text(path)
    lines = R.read_text_lines(spark, path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _write_records(spark: SparkSession, sf: str) -> str:
    """Embeddings as fixed-width records, one file per partition."""
    path = Wr.scratch_dir(spark)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05d}.b") as out:
            for pdf in batches:
                for key, vec in zip(pdf["key"], pdf["embedding"], strict=True):
                    out.write(key.encode().ljust(10) + np.asarray(vec, dtype="<f4").tobytes())
        yield pd.DataFrame({"done": [1]})

    vecs = T.table(spark, sf, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("key"), "embedding")
    vecs.mapInPandas(save, "done int").count()
    return path


@query("read_binary_blobs", "SELECT CAST(count(*) * 266 AS BIGINT) AS total_bytes FROM embeddings")
def read_binary_blobs(spark, sf):
    return R.read_binary_blobs(spark, _write_records(spark, sf)).agg(F.sum(F.length("content")).alias("total_bytes"))


@query(
    "read_feature_records",
    f"""SELECT 'V' || CAST(vec_id AS VARCHAR) AS asin, CAST(len(embedding) AS BIGINT) AS dim,
      {s6("embedding[1]")} AS first_value, {s6("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))")} AS total
    FROM embeddings""",
)
def read_feature_records(spark, sf):
    recs = R.read_feature_records(spark, _write_records(spark, sf), key_len=10, dim=64)
    return recs.select(
        "asin",
        F.size("features").cast("bigint").alias("dim"),
        r6(F.get("features", F.lit(0)).cast("double")).alias("first_value"),
        r6(C.total(F.col("features"))).alias("total"),
    )


@query(
    "chunk_fixed_stride",
    f"""SELECT vec_id AS rec, CAST(vec_id AS DOUBLE) AS key, CAST(64 AS BIGINT) AS n,
      {s6("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))")} AS total FROM embeddings""",
)
def chunk_fixed_stride(spark, sf):
    """Each vector laid out flat as (id, 64 values), then cut again."""
    flat = T.table(spark, sf, "embeddings").select(
        "vec_id",
        F.posexplode(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))).alias("p", "value"),
    )
    seq = flat.select((F.col("vec_id") * 65 + F.col("p")).alias("pos"), "value")
    return R.chunk_fixed_stride(seq, 64).select(
        "rec", "key", F.size("values").cast("bigint").alias("n"), r6(C.total(F.col("values"))).alias("total")
    )


@query(
    "parse_vector_strings",
    f"""SELECT vec_id AS label, CAST(len(embedding) AS BIGINT) AS dim,
      {s6("list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)))")} AS total FROM embeddings""",
)
def parse_vector_strings(spark, sf):
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string"))
    text = F.concat(F.lit("["), F.array_join(rounded, ","), F.lit("]"))
    df = T.table(spark, sf, "embeddings").select("vec_id", text.alias("t"))
    return R.parse_vector_strings(df, "vec_id", "t").select(
        "label", F.size("features").cast("bigint").alias("dim"), r6(C.total(F.col("features"))).alias("total")
    )


@query("write_csv", "SELECT p_partkey AS item, p_brand AS brand, p_retailprice AS price FROM part")
def write_csv(spark, sf):
    path = Wr.scratch_dir(spark)
    cols = [F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")]
    Wr.write_csv(T.table(spark, sf, "part").select(*cols), path)
    return spark.read.csv(path, header=True, schema="item bigint, brand string, price double")


@query(
    "append_run_log",
    f"""WITH {BRAND} SELECT item_id AS run, {s6("avg(rating)")} AS metric, pass FROM ratings, (SELECT unnest([0, 1]) AS pass) GROUP BY item_id, pass""",
)
def append_run_log(spark, sf):
    path = Wr.scratch_dir(spark)
    runs = T.brand_ratings(spark, sf).groupBy(F.col("item_id").alias("run")).agg(r6(F.avg("rating")).alias("metric"))
    for p in (0, 1):
        Wr.append_run_log(runs.withColumn("pass", F.lit(p)), path)
    return Wr.read_run_log(spark, path)


# ---------------------------------------------------------------- projections, filters, cleaning


@query("select_ratings", f"""WITH {REVIEWS} SELECT "reviewerID" AS user_id_str, asin AS item_id_str, overall AS rating FROM reviews""")
def select_ratings(spark, sf):
    return K.select_ratings(T.reviews(spark, sf), ["reviewerID", "asin", "overall"])


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf):
    return K.drop_columns(T.table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "time_stamp")


@query("cast_ratings", f"""WITH {RATINGS} SELECT user_id, item_id, CASE WHEN rating <> 3 THEN rating END AS rating FROM ratings""")
def cast_ratings(spark, sf):
    r = T.ratings(spark, sf).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("item_id"),
        F.when(F.col("rating") != 3, F.col("rating").cast("string")).otherwise("n/a").alias("rating"),
    )
    return K.cast_ratings(r)


@query("zero_base_ids", f"WITH {RATINGS} SELECT user_id - 1 AS user_id, item_id - 1 AS item_id, rating FROM ratings")
def zero_base_ids(spark, sf):
    return K.zero_base_ids(T.ratings(spark, sf), "user_id", "item_id")


ATTRS = "SELECT p_partkey AS item, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand FROM part"


@query("filter_not_null", f"SELECT item, brand FROM ({ATTRS}) WHERE brand IS NOT NULL")
def filter_not_null(spark, sf):
    return K.filter_not_null(T.item_attributes(spark, sf), "brand").select("item", "brand")


@query("filter_null", f"SELECT item, brand FROM ({ATTRS}) WHERE brand IS NULL")
def filter_null(spark, sf):
    return K.filter_null(T.item_attributes(spark, sf), "brand").select("item", "brand")


@query("filter_positive", f"WITH {RATINGS} SELECT user_id, item_id, rating - 3 AS rating FROM ratings WHERE rating - 3 > 0")
def filter_positive(spark, sf):
    return K.filter_positive(T.ratings(spark, sf).withColumn("rating", F.col("rating") - 3))


@query("flag_not_null", f"SELECT item, CAST(price IS NOT NULL AS INTEGER) AS has_price FROM ({ATTRS})")
def flag_not_null(spark, sf):
    return K.with_flag(T.item_attributes(spark, sf), "price", "has_price").select("item", "has_price")


@query("fill_null_const", f"SELECT item, coalesce(brand, 'No Brand') AS brand FROM ({ATTRS})")
def fill_null_const(spark, sf):
    return K.fill_null_const(T.item_attributes(spark, sf), "brand", "No Brand").select("item", "brand")


@query("strip_chars", "SELECT doc_id, md5(regexp_replace(text, '[aeiou]', '', 'g')) AS stripped FROM documents")
def strip_chars(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.md5(C.strip_chars(F.col("text"), "[aeiou]")).alias("stripped"))


@query("split_nth", "SELECT doc_id, string_split(text, ',')[2] AS field FROM documents")
def split_nth(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", C.split_nth(F.col("text"), 1).alias("field"))


@query(
    "explode_list_column",
    f"""WITH {VIEWBUY} SELECT CAST(item AS VARCHAR) AS item_id, CAST(price AS VARCHAR) AS price, brand,
      CAST(other AS VARCHAR) AS user_also_view FROM viewed LEFT JOIN attrs USING (item)""",
)
def explode_list_column(spark, sf):
    meta = T.metadata(spark, sf).withColumnRenamed("asin", "item_id")
    return K.explode_list_column(meta, "also_viewed", ["item_id", "price", "brand"], "user_also_view")


@query(
    "flatten_related",
    "SELECT p_partkey AS asin, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS kind FROM part",
)
def flatten_related(spark, sf):
    nested = T.table(spark, sf, "part").select(
        F.col("p_partkey").alias("asin"),
        F.when(F.col("p_partkey") % 5 != 0, F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))).alias("related"),
    )
    return K.flatten_related(nested)


@query("coalesce_default", f"SELECT item, coalesce(price, 0) AS price FROM ({ATTRS})")
def coalesce_default(spark, sf):
    a = T.item_attributes(spark, sf).select("item", F.col("price").cast("double").alias("price"))
    return J.coalesce_default(a, ["price"], 0.0)


@query(
    "row_index",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, 'SENT_' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS tag FROM documents",
)
def row_index(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id")
    return K.row_index(docs, "doc_id").withColumn("tag", F.concat(F.lit("SENT_"), F.col("idx").cast("string")))


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM orders"
        for c, t in [
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "double"),
            ("o_orderdate", "timestamp"),
            ("o_orderpriority", "string"),
        ]
    ),
)
def table_profile(spark, sf):
    o = T.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return K.table_profile(o)


@query(
    "feature_vector",
    f"""SELECT p_partkey AS item, CAST(2 AS BIGINT) AS dim, CAST(p_size AS DOUBLE) AS f0, {s6("p_retailprice")} AS f1 FROM part""",
)
def feature_vector(spark, sf):
    v = K.feature_vector(T.table(spark, sf, "part"), ["p_size", "p_retailprice"])
    return v.select(
        F.col("p_partkey").alias("item"),
        F.size("features").cast("bigint").alias("dim"),
        F.get("features", F.lit(0)).alias("f0"),
        r6(F.get("features", F.lit(1))).alias("f1"),
    )


# ---------------------------------------------------------------- identifiers

DENSE_USER = "(SELECT \"reviewerID\", row_number() OVER (ORDER BY md5(\"reviewerID\"), \"reviewerID\") - 1 AS user_id FROM (SELECT DISTINCT \"reviewerID\" FROM reviews))"
DENSE_ITEM = "(SELECT asin, row_number() OVER (ORDER BY md5(asin), asin) - 1 AS item_id FROM (SELECT DISTINCT asin FROM reviews))"


@query("assign_ids", f"WITH {REVIEWS} SELECT user_id, item_id, overall AS rating FROM reviews JOIN {DENSE_USER} USING (\"reviewerID\") JOIN {DENSE_ITEM} USING (asin)")
def assign_ids(spark, sf):
    df = cut_lineage(T.reviews(spark, sf).withColumnRenamed("overall", "rating"))
    return E.assign_ids(df, {"reviewerID": "user_id", "asin": "item_id"})


@query("join_ids", f"WITH {REVIEWS} SELECT \"reviewerID\", asin, user_id, item_id, overall FROM reviews JOIN {DENSE_USER} USING (\"reviewerID\") JOIN {DENSE_ITEM} USING (asin)")
def join_ids(spark, sf):
    df = cut_lineage(T.reviews(spark, sf))
    return E.join_ids(df, [(E.id_map(df, "reviewerID", "user_id"), "reviewerID"), (E.id_map(df, "asin", "item_id"), "asin")])


@query(
    "label_encode",
    "SELECT p_partkey, p_brand, p_type, p_name, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand_int, dense_rank() OVER (ORDER BY p_type) - 1 AS type_int, dense_rank() OVER (ORDER BY p_name) - 1 AS name_int FROM part",
)
def label_encode(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return E.label_encode(p, {"p_brand": "brand_int", "p_type": "type_int", "p_name": "name_int"})


# ---------------------------------------------------------------- joins


def _view_buy(spark, sf):
    meta = cut_lineage(T.metadata(spark, sf).withColumnRenamed("asin", "item_id"))
    viewed = K.explode_list_column(meta, "also_viewed", ["item_id", "price", "brand"], "user_also_view")
    bought = K.explode_list_column(meta, "buy_after_viewing", ["item_id"], "user_buy_after_viewing")
    return viewed, bought


VB_COLS = "CAST(v.item AS VARCHAR) AS item_id, CAST(price AS VARCHAR) AS price, brand, CAST(v.other AS VARCHAR) AS user_also_view"


@query(
    "view_buy_left_join",
    f"""WITH {VIEWBUY} SELECT {VB_COLS}, CAST(b.other AS VARCHAR) AS user_buy_after_viewing
    FROM viewed v LEFT JOIN bought b ON v.item = b.item AND v.other = b.other LEFT JOIN attrs ON attrs.item = v.item""",
)
def view_buy_left_join(spark, sf):
    return J.view_buy_left_join(*_view_buy(spark, sf))


@query("viewed_and_bought", f"WITH {VIEWBUY} SELECT {VB_COLS} FROM viewed v SEMI JOIN bought b ON v.item = b.item AND v.other = b.other LEFT JOIN attrs ON attrs.item = v.item")
def viewed_and_bought(spark, sf):
    return J.viewed_and_bought(*_view_buy(spark, sf))


@query("viewed_not_bought", f"WITH {VIEWBUY} SELECT {VB_COLS} FROM viewed v ANTI JOIN bought b ON v.item = b.item AND v.other = b.other LEFT JOIN attrs ON attrs.item = v.item")
def viewed_not_bought(spark, sf):
    return J.viewed_not_bought(*_view_buy(spark, sf))


# Ratings on even items are taken as scored positives, on odd items as scored negatives.
POSNEG = f"""{RATINGS}, scored AS (SELECT user_id, item_id % 2 AS kind, rating + item_id % 10 AS prediction FROM ratings),
pairs AS (SELECT p.user_id, p.prediction, n.prediction AS other FROM scored p JOIN scored n ON p.user_id = n.user_id WHERE p.kind = 0 AND n.kind = 1)"""


def _pos_neg(spark, sf):
    scored = cut_lineage(T.ratings(spark, sf)).select("user_id", "item_id", (F.col("rating") + F.col("item_id") % 10).alias("prediction"))
    pos, neg = scored.filter("item_id % 2 = 0"), scored.filter("item_id % 2 = 1")
    return J.pos_neg_pairs(pos, neg)


@query(
    "pos_neg_pairs",
    f"""WITH {POSNEG}, negs AS (SELECT user_id, count(*) AS n_neg FROM scored WHERE kind = 1 GROUP BY 1)
    SELECT user_id, prediction, CAST(count(*) / any_value(n_neg) AS BIGINT) AS n_pos, any_value(n_neg) AS n_neg,
      CAST(count(*) FILTER (prediction > other) / (count(*) / any_value(n_neg)) AS BIGINT) AS n_wins
    FROM pairs JOIN negs USING (user_id) GROUP BY user_id, prediction""",
)
def pos_neg_pairs(spark, sf):
    return _pos_neg(spark, sf)


@query("counts_left_outer", f"WITH {POSNEG} SELECT user_id, count(*) AS total, count(*) FILTER (prediction > other) AS correct FROM pairs GROUP BY user_id")
def counts_left_outer(spark, sf):
    return J.counts_left_outer(_pos_neg(spark, sf))


@query(
    "anti_testset",
    f"WITH {BRAND} SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM ratings), (SELECT DISTINCT item_id FROM ratings) EXCEPT SELECT user_id, item_id FROM ratings",
)
def anti_testset(spark, sf):
    return J.anti_testset(cut_lineage(T.brand_ratings(spark, sf)))


@query("merge_metadata", f"""WITH {REVIEWS}, attrs AS ({ATTRS}) SELECT "reviewerID", asin, overall, brand FROM reviews LEFT JOIN attrs ON asin = 'B' || lpad(CAST(item AS VARCHAR), 9, '0') AND brand IS NOT NULL""")
def merge_metadata(spark, sf):
    meta = T.item_attributes(spark, sf).filter("brand IS NOT NULL").select(
        F.concat(F.lit("B"), F.lpad(F.col("item").cast("string"), 9, "0")).alias("asin"), "brand"
    )
    return J.merge_metadata(T.reviews(spark, sf), meta)


# ---------------------------------------------------------------- aggregates


@query("distinct_values", f"WITH {RATINGS} SELECT DISTINCT item_id FROM ratings")
def distinct_values(spark, sf):
    return A.distinct_values(T.ratings(spark, sf), "item_id")


@query("count_by_key", f"WITH {RATINGS} SELECT user_id, count(*) AS n FROM ratings GROUP BY user_id")
def count_by_key(spark, sf):
    return A.count_by_key(T.ratings(spark, sf), "user_id")


@query("global_mean_positive", f"WITH {RATINGS} SELECT sum(rating) AS rating_sum, count(*) AS n_ratings, {s6('avg(rating)')} AS global_mean FROM ratings WHERE rating > 0")
def global_mean_positive(spark, sf):
    return A.global_mean_positive(T.ratings(spark, sf)).withColumn("global_mean", r6("global_mean"))


@query(
    "item_means_zero_filled",
    f"""WITH {RATINGS}, t AS (SELECT count(DISTINCT user_id) AS n, avg(rating) FILTER (rating > 0) AS g FROM ratings)
    SELECT item_id, {s6("CASE WHEN sum(rating) / any_value(n) > 0 THEN sum(rating) / any_value(n) ELSE any_value(g) END")} AS item_mean FROM ratings, t GROUP BY item_id""",
)
def item_means_zero_filled(spark, sf):
    return A.item_means_zero_filled(T.ratings(spark, sf)).withColumn("item_mean", r6("item_mean"))


@query(
    "matrix_shape",
    f"WITH {RATINGS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings, {s6('count(*) / (CAST(count(DISTINCT user_id) AS DOUBLE) * count(DISTINCT item_id))')} AS density FROM ratings",
)
def matrix_shape(spark, sf):
    return A.matrix_shape(T.ratings(spark, sf)).withColumn("density", r6("density"))


@query("rating_histogram", f"WITH {RATINGS} SELECT rating, count(*) AS n FROM ratings GROUP BY rating")
def rating_histogram(spark, sf):
    return A.rating_histogram(T.ratings(spark, sf))


@query("value_histogram", "SELECT CAST(floor(o_totalprice / 5000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def value_histogram(spark, sf):
    return A.value_histogram(T.table(spark, sf, "orders"), "o_totalprice", 0.0, 5000.0)


@query("class_counts", f"WITH {TEXTS} SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM texts GROUP BY 1")
def class_counts(spark, sf):
    return A.class_counts(T.review_texts(spark, sf), "label")


@query(
    "per_user_auc",
    f"""WITH {POSNEG}, u AS (SELECT user_id, avg(CAST(prediction > other AS INTEGER)) AS auc FROM pairs GROUP BY user_id)
    SELECT count(*) AS n_users, {s6('avg(auc)')} AS mean_auc FROM u""",
)
def per_user_auc(spark, sf):
    from affinity.operators.metrics import mean_auc

    return mean_auc(J.counts_left_outer(_pos_neg(spark, sf))).withColumn("mean_auc", r6("mean_auc"))


# The error of guessing each order status' mean price, per priority: a stand-in run log.
RUNS = """runs AS (SELECT o_orderpriority AS model, o_orderstatus AS run, round(avg(o_totalprice), 2) AS rmse,
  CAST(count(*) % 5 AS DOUBLE) AS lr FROM orders GROUP BY 1, 2)"""


def _runs(spark, sf):
    return (
        T.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("run"))
        .agg(F.round(F.avg("o_totalprice"), 2).alias("rmse"), (F.count(F.lit(1)) % 5).cast("double").alias("lr"))
    )


@query("best_by_metric", f"WITH {RUNS} SELECT model, min(rmse) AS best_rmse, arg_min(run, (rmse, run)) AS best_run FROM runs GROUP BY model")
def best_by_metric(spark, sf):
    return A.best_by_metric(_runs(spark, sf), "model", "rmse", "run")


@query("rank_runs", f"WITH {RUNS} SELECT * FROM runs ORDER BY rmse, model, run LIMIT 5")
def rank_runs(spark, sf):
    return A.rank_runs(_runs(spark, sf), "rmse", "model", "run").limit(5)


@query("lr_curve", f"WITH {RUNS} SELECT lr, {s6('avg(rmse)')} AS mean_rmse, count(*) AS n_runs FROM runs GROUP BY lr")
def lr_curve(spark, sf):
    return A.lr_curve(_runs(spark, sf), "lr", "rmse").withColumn("mean_rmse", r6("mean_rmse"))


@query("limit_rows", f"WITH {RATINGS} SELECT user_id, item_id, rating FROM ratings ORDER BY user_id, item_id LIMIT 10")
def limit_rows(spark, sf):
    return K.limit_rows(T.ratings(spark, sf), 10, "user_id", "item_id")


@query("union_labeled", f"WITH {RATINGS} SELECT item_id, user_id, 1 AS label FROM ratings WHERE rating >= 4 UNION ALL SELECT item_id, user_id, 0 FROM ratings WHERE rating < 4")
def union_labeled(spark, sf):
    r = T.ratings(spark, sf)
    pos = r.filter("rating >= 4").select("item_id", "user_id", F.lit(1).alias("label"))
    neg = r.filter("rating < 4").select(F.lit(0).alias("label"), "user_id", "item_id")
    return K.union_labeled(pos, neg)


# ---------------------------------------------------------------- splits and samples

HASH = "CAST(concat('0x', substr(md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), 1, 8)) AS BIGINT)"


@query("random_split")
def random_split(spark, sf):
    train, test = S.random_split(T.ratings(spark, sf), [0.8, 0.1])
    tagged = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("hash_split", f"WITH {RATINGS} SELECT user_id, item_id, rating, CAST({HASH} % 100 < 20 AS INTEGER) AS is_test FROM ratings")
def hash_split(spark, sf):
    return S.hash_split(T.ratings(spark, sf), ["user_id", "item_id"], 20)


@query("kfold_assign", f"WITH {RATINGS} SELECT user_id, item_id, rating, CAST({HASH} % 10 AS INTEGER) AS fold FROM ratings")
def kfold_assign(spark, sf):
    return S.kfold_assign(T.ratings(spark, sf), ["user_id", "item_id"], 10)


@query(
    "balanced_class_sample",
    f"""WITH {TEXTS}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM texts),
    d AS (SELECT label, size, unnest(range(5000)) AS draw FROM (SELECT label, count(*) AS size FROM texts GROUP BY 1))
    SELECT CAST(d.label AS INTEGER) AS label, CAST(draw AS INTEGER) AS draw, doc_id FROM d JOIN r ON r.label = d.label
      AND r.rank = CAST(floor(CAST(concat('0x', substr(md5('17|' || d.label || '|' || draw), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) * size) AS BIGINT)""",
)
def balanced_class_sample(spark, sf):
    docs = T.review_texts(spark, sf).select("doc_id", "label")
    return S.balanced_class_sample(docs, "label", "doc_id", 5000)


@query("sample_fraction")
def sample_fraction(spark, sf):
    return S.sample_fraction(T.ratings(spark, sf), 0.1)


LOW_HIGH = "lab AS (SELECT user_id * 1000000 + item_id AS rid, CAST(rating = 5 AS INTEGER) AS label FROM ratings)"


@query(
    "downsample_negatives",
    f"""WITH {RATINGS}, {LOW_HIGH}, n AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(rid AS VARCHAR)), rid) - 1 AS i FROM lab WHERE label = 0)
    SELECT rid, label FROM lab WHERE label = 1 UNION ALL SELECT rid, label FROM n WHERE i < (SELECT count(*) FROM lab WHERE label = 1)""",
)
def downsample_negatives(spark, sf):
    lab = cut_lineage(
        T.ratings(spark, sf).select(
            (F.col("user_id") * 1000000 + F.col("item_id")).alias("rid"), (F.col("rating") == 5).cast("int").alias("label")
        )
    )
    return S.downsample_negatives(lab, "label", "rid", 1.0)


@query(
    "negative_sample",
    f"""WITH {RATINGS}, items AS (SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ratings)),
    n AS (SELECT count(*) AS n FROM items),
    step AS (SELECT min(s) AS s FROM (SELECT unnest(range(CAST(floor(0.618 * n) AS BIGINT), 2 * n + 2)) AS s, n FROM n) WHERE s >= 1 AND gcd(s, n) = 1),
    users AS (SELECT user_id, count(*) AS p FROM ratings GROUP BY 1),
    tries AS (SELECT user_id, p, unnest(range(least(2 * p, n.n))) AS t FROM users, n),
    cand AS (SELECT user_id, p, t, (CAST(concat('0x', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % n.n + t * s) % n.n AS idx FROM tries, n, step),
    neg AS (SELECT user_id, item_id, p, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM cand JOIN items USING (idx) ANTI JOIN ratings USING (user_id, item_id))
    SELECT user_id, item_id FROM neg WHERE k <= p""",
)
def negative_sample(spark, sf):
    return S.negative_sample(cut_lineage(T.ratings(spark, sf)))
