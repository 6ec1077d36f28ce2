import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from affinity.operators import classify as C
from affinity.operators import metrics as M
from affinity.operators import split as SP
from affinity.operators import tuning as TU
from affinity.operators import viewbuy as VB


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    s = np.round(y * 0.4 + rng.normal(size=200), 1)  # many ties across classes
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double").cache()


def test_auc_equals_the_evaluator_and_the_rank_form(spark, scored):
    auc = M.auc_trapezoid(scored, "label", "score").first()["auc"]
    data = scored.collect()
    pos = [r["score"] for r in data if r["label"] == 1]
    neg = [r["score"] for r in data if r["label"] == 0]
    rank = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc == pytest.approx(rank)
    d = scored.withColumn("label", F.col("label").cast("double"))
    assert auc == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(d), abs=0.01)


def test_curves(spark, scored):
    roc = sorted(M.roc_curve(scored, "label", "score").collect(), key=lambda r: -r["threshold"])
    assert roc[-1]["fpr"] == 1 and roc[-1]["tpr"] == 1
    assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(roc, roc[1:], strict=False))
    x, y = [0.0] + [r["fpr"] for r in roc], [0.0] + [r["tpr"] for r in roc]
    area = sum((x[i] - x[i - 1]) * (y[i] + y[i - 1]) / 2 for i in range(1, len(x)))
    assert M.auc_trapezoid(scored, "label", "score").first()["auc"] == pytest.approx(area)
    pr = sorted(M.pr_curve(scored, "label", "score").collect(), key=lambda r: -r["threshold"])
    ap, last = 0.0, 0.0
    for r in pr:
        ap, last = ap + (r["recall"] - last) * r["precision"], r["recall"]
    assert M.average_precision(scored, "label", "score").first()["average_precision"] == pytest.approx(ap)
    hard = scored.withColumn("pred", (F.col("score") > 0).cast("int"))
    assert M.roc_curve(hard, "label", "pred").count() == 2


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "label int, score double")
    assert M.auc_trapezoid(df, "label", "score").first()["auc"] is None
    assert {r["fpr"] for r in M.roc_curve(df, "label", "score").collect()} == {None}


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "y int, p int")
    assert tuple(M.binary_confusion(df, "y", "p").first()) == (1, 1, 1, 2)
    assert rows(M.confusion_matrix(df, "y", "p")) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    assert M.accuracy(df, "p", "y").first()["accuracy"] == pytest.approx(0.6)
    assert tuple(M.error_rate(df, "p", "y").first()) == (2, 5, 0.4)


def test_impute_and_scale_use_the_train_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(None, 5.0), (4.0, 6.0)], "a double, b double")
    full = C.impute_mean(train, train, ["a"])
    assert sorted(r["a"] for r in C.impute_mean(train, test, ["a"]).collect()) == [2.0, 4.0]
    got = sorted(tuple(r) for r in C.scale_standard(full, C.impute_mean(train, test, ["a"]), ["a", "b"]).collect())
    dev = np.std([1, 2, 3])
    assert got == [(0.0, 0.0), (pytest.approx(2 / dev), 1.0)]


def test_view_buy_dataset(spark):
    meta = spark.createDataFrame(
        [("X", "1.5", None, "['A', 'B']", None), ("X", "1.5", None, None, "['B']"), ("Y", "oops", "Acme", "['A']", "[]")],
        "asin string, price string, brand string, also_viewed string, buy_after_viewing string",
    )
    got = rows(VB.view_buy_dataset(meta).select("item_id", "user_also_view", "price", "brand", VB.LABEL, "item_id_int", "user_also_view_int", "brand_int"))
    assert got == [
        ("X", "A", 1.5, "No Brand", 0, 0, 0, 1),
        ("X", "B", 1.5, "No Brand", 1, 0, 1, 1),
        ("Y", "A", None, "Acme", 0, 1, 0, 0),
    ]


@pytest.fixture(scope="module")
def rings(spark):
    """Inner disc against outer ring: no line parts them, a kernel does."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(240):
        y = i % 2
        r, a = (0.5 if y else 2.0) + rng.normal(scale=0.1), rng.uniform(0, 6.28)
        out.append((i, float(y), [float(r * np.cos(a)), float(r * np.sin(a))]))
    return C.with_vector(spark.createDataFrame(out, "id bigint, label double, f array<double>"), "f").drop("f").cache()


def test_kernel_beats_linear(rings):
    folds = SP.kfold_assign(rings, ["id"], 2).select("label", "features", "fold")
    best = C.svm_grid(folds, 2, [10], [0.5], folds=2, rff_dim=32, max_iter=15).collect()
    acc = {r["kernel"]: r["accuracy"] for r in best}
    assert acc["rbf"] > 0.95 > acc["linear"] and best[0]["kernel"] == "rbf"


def test_forest_mlp_and_logistic(rings):
    folds = SP.kfold_assign(rings, ["id"], 2)
    assert max(C.random_forest_grid(folds, [5], folds=2).avgMetrics) > 0.9
    probs = C.mlp_embedding(C.mlp([2, 4, 2], max_iter=5).fit(rings), rings, "id")
    assert all(abs(sum(r["embedding"]) - 1) < 1e-9 for r in probs.collect())
    terms = [r["term"] for r in C.logistic_summary(rings).collect()]
    assert terms == ["x0", "x1", "const"]
    p = C.positive_probability(C.logistic().fit(rings), rings)
    assert p.filter("probability_1 < 0 OR probability_1 > 1").count() == 0


def test_best_models_are_judged_on_the_hold_out(rings, tmp_path):
    train, test = SP.train_test(rings, ["id"], 30)
    folds = SP.kfold_assign(train, ["id"], 2).select("label", "features", "fold")
    grid = C.svm_grid(folds, 2, [10], [0.5], folds=2, rff_dim=32, max_iter=15)
    best = TU.svm_best(grid, train, test, 2, str(tmp_path), rff_dim=32, max_iter=15).first()
    assert best["kernel"] == "rbf" and best["gamma"] == 0.5
    assert best["tn"] + best["fp"] + best["fn"] + best["tp"] == test.count()
    assert best["accuracy"] > 0.95 and best["auc"] > 0.99 and best["auc_labels"] > 0.95
    again = TU.svm_best(grid, train.limit(0), test, 2, str(tmp_path), rff_dim=32, max_iter=15).first()  # loaded: no rows to fit
    assert again == best
    one = TU.svm_best(grid, train, test.filter("label = 1"), 2, str(tmp_path), rff_dim=32).first()
    assert one["auc"] is None and one["tp"] + one["fn"] == test.filter("label = 1").count()
    model = C.random_forest_grid(SP.kfold_assign(train, ["id"], 2), [1, 5], folds=2)
    forest = TU.forest_best(model, [1, 5], test).first()
    assert forest["trees"] == model.bestModel.getNumTrees and forest["n"] == test.count() and forest["accuracy"] > 0.9
    assert forest["cv_accuracy"] == max(model.avgMetrics)


def test_compare_embeddings_runs_inferred_vectors_and_marks_the_best(spark):
    rows = [(i, float(i % 2), ([f"good{i % 3}", "fine"] if i % 2 else [f"bad{i % 3}", "poor"]) + ["the"] * (i % 4)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, label double, tokens array<string>").cache()
    trained_on = []

    def fit(texts, passes):
        trained_on.append((passes, texts.count()))
        return passes

    def marked(noise):  # a vector that tells the label, or nothing
        return lambda model, d: d.select("doc_id", F.array(F.when(F.lit(noise), 0.0).otherwise(F.col("label")) + F.col("doc_id") % 7 * 0.01).alias("docvec"))

    got = TU.compare_embeddings(docs, "doc_id", "label", fit, {"sure": marked(False), "blind": marked(True)}, (1, 2), infer_every=2).collect()
    train, test = SP.train_test(docs, ["doc_id"], 20)
    assert trained_on == [(p, n) for p in (1, 2) for n in (80, train.count())]
    names = {"sure", "blind", "sure_inferred", "blind_inferred"}
    assert {(r["model"], r["pass"]) for r in got} == {(m, p) for m in names for p in (1, 2)}
    assert all(r["n"] == test.count() and r["best_so_far"] for r in got)  # equal errors beat none, so all are best
    assert all(r["error_rate"] == 0 for r in got if r["model"].startswith("sure"))
