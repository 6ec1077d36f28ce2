import gzip

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import Observation

from affinity.operators.clean import explode_list_column
from affinity.operators.joins import viewed_and_bought
from affinity.sources import readers as R
from affinity.sources import writers as Wr


def test_loose_json(spark, tmp_path):
    lines = [
        "{'reviewerID': 'A', 'asin': 'B1', 'overall': 5.0, 'reviewText': \"it's fine\"}",
        '{"reviewerID": "C", "asin": "B2", "overall": 3.0, "reviewText": "plain json"}',
        "{'reviewerID': u'D', 'asin': 'B3', 'overall': None, 'reviewText': 'uses \\x41'}",
        "{'reviewerID': 'E', 'asin': __import__('os').getcwd()}",
        "not a dict",
    ]
    path = tmp_path / "r.json.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = {r["reviewerID"]: r for r in R.read_loose_json(spark, str(path)).collect()}
    assert got["A"]["reviewText"] == "it's fine" and got["C"]["overall"] == 3.0
    assert got["D"]["overall"] is None and got["D"]["reviewText"] == "uses A"
    bad = R.read_loose_json(spark, str(path)).filter(f"{R.CORRUPT} IS NOT NULL").collect()
    assert sorted(r[R.CORRUPT] for r in bad) == sorted(lines[3:])
    seen = Observation()
    df = R.read_loose_json(spark, str(path), observation=seen)
    assert len(df.collect()) == 5 and seen.get == {"lines": 5, "bad": 2}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1  # one pass
    nested = "asin string, related struct<also_viewed: array<string>>"
    more = tmp_path / "m.txt"
    more.write_text("{'asin': u'A', 'related': {'also_viewed': ['B', 'C']}}\n{'asin': 'D', 'related': {'also_viewed': []}}\n")
    got = {r["asin"]: r["related"]["also_viewed"] for r in R.read_loose_json(spark, str(more), nested).collect()}
    assert got == {"A": ["B", "C"], "D": []}


def test_reviews_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"reviewerID": "A", "asin": "B", "overall": 4.0, "reviewText": "x", "helpful": [0, 1]}\n')
    assert [tuple(r) for r in R.read_reviews_json(spark, str(tmp_path / "r.json")).collect()] == [("A", "B", 4.0, "x")]


def test_ratings_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,i,r\nu1,i1,4\nu2,i2,?\n")
    assert [tuple(r) for r in R.read_ratings_csv(spark, str(tmp_path / "a.csv")).collect()] == [("u1", "i1", 4.0), ("u2", "i2", None)]
    (tmp_path / "b.csv").write_text("u1,i1,4,1370000000\n?,i2,2,1370000001\n")
    got = R.read_ratings_csv_noheader(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in got.collect()] == [("u1", "i1", 4.0), (None, "i2", 2.0)]


def test_metadata_lists(spark, tmp_path):
    """Elements match whatever their place in the list; blanks, repeats and empty lists give nothing extra."""
    (tmp_path / "m.csv").write_text(
        "asin,price,brand,also_viewed,buy_after_viewing\n"
        "X,1.5,Acme,\"['A', 'B', 'B']\",\"['B', 'A']\"\n"
        "Y,,,\"['C']\",[]\n"
        "Z,2.0,Acme,,\n"
    )
    meta = R.read_metadata_csv(spark, str(tmp_path / "m.csv")).withColumnRenamed("asin", "item_id")
    viewed = explode_list_column(meta, "also_viewed", ["item_id"], "user_also_view")
    bought = explode_list_column(meta, "buy_after_viewing", ["item_id"], "user_buy_after_viewing")
    assert sorted(tuple(r) for r in viewed.collect()) == [("X", "A"), ("X", "B"), ("Y", "C")]
    assert sorted(tuple(r) for r in bought.collect()) == [("X", "A"), ("X", "B")]
    assert viewed_and_bought(viewed, bought).count() == 2


def test_feature_records(spark, tmp_path):
    vecs = np.arange(80, dtype="<f4").reshape(5, 16)
    data = b"".join(f"item{i}".encode().ljust(10) + v.tobytes() for i, v in enumerate(vecs))
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "f.b").write_bytes(data)
    got = {r["asin"]: r["features"] for r in R.read_feature_records(spark, str(tmp_path / "good"), 10, 16).collect()}
    assert got == {f"item{i}": v.tolist() for i, v in enumerate(vecs)}
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "f.b").write_bytes(data[:-3])
    with pytest.raises(ValueError, match="multiple"):
        R.read_feature_records(spark, str(tmp_path / "short"), 10, 16)
    assert R.read_binary_blobs(spark, str(tmp_path / "good")).first()["length"] == len(data)


def test_fixed_stride(spark):
    seq = spark.createDataFrame([(i, float(i)) for i in range(10)], "pos bigint, value double")
    got = sorted(tuple(r) for r in R.chunk_fixed_stride(seq, 4).collect())
    assert got == [(0, 0.0, [1.0, 2.0, 3.0, 4.0]), (1, 5.0, [6.0, 7.0, 8.0, 9.0])]


def test_vector_text(spark):
    df = spark.createDataFrame([(1, "[0.5, 1e-2]"), (2, "[0.5 2]"), (3, "[x]"), (4, None)], "l int, t string")
    assert [r["features"] for r in R.parse_vector_strings(df, "l", "t").orderBy("label").collect()] == [[0.5, 0.01], [0.5, 2.0], None, None]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, None)]
    Wr.write_csv(spark.createDataFrame(rows, "i int, t string").repartition(2), str(tmp_path / "y"))
    back = spark.read.csv(str(tmp_path / "y"), header=True, schema="i int, t string", escape='"')
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_run_log_appends(spark, tmp_path):
    for i in range(2):
        Wr.append_run_log(spark.createDataFrame([(i, 0.5)], "run int, rmse double"), str(tmp_path / "log"))
    assert Wr.read_run_log(spark, str(tmp_path / "log")).count() == 2


def test_model_is_fitted_once(spark, tmp_path):
    from affinity.operators.classify import svm_linear, with_vector

    df = with_vector(spark.createDataFrame([(0.0, [0.0, 1.0]), (1.0, [1.0, 0.0])] * 5, "label double, f array<double>"), "f")
    fits = []

    def fit():
        fits.append(1)
        return svm_linear(1.0, 10).fit(df)

    for _ in range(2):
        m = Wr.get_or_fit_model(spark, str(tmp_path / "m"), LinearSVCModel, fit)
    assert len(fits) == 1 and m.transform(df).filter("prediction <> label").count() == 0
