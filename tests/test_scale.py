import random

import pytest
from pyspark.sql import functions as F

from affinity.operators import encode as E
from affinity.operators import scale as S
from affinity.session import cut_lineage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_split_join_equals_plain_join(spark, skewed):
    a = skewed.select("user_id", F.col("item_id").alias("i"))
    b = skewed.select("user_id", F.col("item_id").alias("j"))
    plain = rows(a.join(b, "user_id").select("user_id", "i", "j"))
    heavy = S.heavy_keys(a, None, ["user_id"], pair_floor=50)
    assert {r["user_id"] for r in heavy.collect()} == {0}
    for same in (True, False):
        cut = S.split_join(a, b, ["user_id"], ["i"], ["j"], pair_floor=50, self_join=same)
        assert rows(cut.select("user_id", "i", "j")) == plain


def test_split_join_one_sided(spark):
    a = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    b = spark.createDataFrame([(0, 10), (1, 11)], "k bigint, y bigint")
    got = S.split_join(a, b, ["k"], ["x"], ["y"], pair_floor=100)
    assert rows(got.select("k", "x", "y")) == rows(a.join(b, "k").select("k", "x", "y"))


def test_heavy_keys_are_bounded(spark):
    a = spark.range(2000).select(F.col("id").alias("k"))
    assert S.heavy_keys(a, None, ["k"], pair_floor=0.5) is not None
    assert S.heavy_keys(a, None, ["k"], pair_floor=0.5).count() <= S.MAX_HEAVY
    assert S.heavy_keys(a, None, ["k"]) is None
    assert S.heavy_keys(a.limit(0), None, ["k"]) is None


@pytest.mark.parametrize("ascending", [True, False])
def test_running_sums(spark, ascending):
    rng = random.Random(3)
    data = [(g, v, rng.randint(0, 9)) for g in "abc" for v in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "g string, v int, x int")
    keys = df.select("v").distinct()
    order = [F.col("v") if ascending else F.col("v").desc()]
    got = S.grouped_sums(df, ["g"], S.range_bucket(keys, "v", 16), order, {"s": F.col("x")}, ascending)
    want = []
    for g in "abc":
        acc = 0
        for _, v, x in sorted((d for d in data if d[0] == g), key=lambda d: d[1], reverse=not ascending):
            acc += x
            want.append((g, v, acc))
    assert rows(got.select("g", "v", "s")) == sorted(want)


def test_ids_are_dense_and_codes_are_sorted(spark):
    df = spark.createDataFrame([(f"k{i % 700:04d}",) for i in range(3000)] + [(None,)], "k string")
    ids = sorted(r["id"] for r in E.id_map(df, "k", "id").collect())
    assert ids == list(range(700))
    codes = E.code_map(df, "k", "c").orderBy("k").collect()
    assert [r["c"] for r in codes] == list(range(700))


def test_codes_equal_string_indexer(spark):
    from pyspark.ml.feature import StringIndexer

    df = spark.createDataFrame([(w,) for w in "pear fig Apple fig kiwi pear".split()], "k string")
    ours = E.label_encode(df, {"k": "c"})
    theirs = StringIndexer(inputCol="k", outputCol="c", stringOrderType="alphabetAsc").fit(df).transform(df)
    assert rows(ours.select("k", "c")) == [(k, int(c)) for k, c in rows(theirs.select("k", "c"))]


def test_cut_lineage_keeps_rows(spark, toy):
    assert rows(cut_lineage(toy)) == rows(toy)


def test_with_row(spark):
    df, one = spark.range(3), spark.range(4).agg(F.sum("id").alias("s"), F.max("id").alias("m"))
    assert rows(S.with_row(df, one)) == [(0, 6, 3), (1, 6, 3), (2, 6, 3)]
