"""Chosen models refitted and judged on rows they have not seen; embeddings compared by a classifier on top of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.base import Model
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinity.operators.classify import decision_scores, logistic, positive_probability, rff, svm_linear, with_vector
from affinity.operators.metrics import auc_trapezoid, binary_confusion, error_rate
from affinity.operators.scale import with_row
from affinity.operators.split import train_test
from affinity.session import cut_lineage, scratch_dir
from affinity.sources.writers import get_or_fit_model

Fit = Callable[[DataFrame, int], Model]
Embed = Callable[[Model, DataFrame], DataFrame]


def svm_best(grid: DataFrame, train: DataFrame, test: DataFrame, dim: int, path: str | None = None, rff_dim: int = 128, max_iter: int = 50) -> DataFrame:
    """One row for the best setting of svm_grid, refitted on all train rows and judged on the hold-out.

    (kernel, c, gamma, cv_accuracy, accuracy, auc, auc_labels, tn, fp, fn, tp). ``auc`` follows the signed margins,
    ``auc_labels`` the predicted classes. The model is stored below ``path`` and loaded from there next time;
    another setting has another folder. A hold-out with one class has no auc.
    """
    spark = train.sparkSession
    best = grid.limit(1).first()

    def mapped(df: DataFrame) -> DataFrame:
        if best["kernel"] == "linear":
            return df
        return rff(df, best["gamma"], dim, rff_dim).drop("features").withColumnRenamed("rff", "features")

    def fit() -> LinearSVCModel:
        rows = cut_lineage(mapped(train.select("label", "features")))
        return svm_linear(best["c"], rows.count(), max_iter).fit(rows)

    folder = f"{path or scratch_dir(spark)}/{best['kernel']}-{best['c']:g}-{best['gamma'] or 0:g}-{rff_dim}"
    model = get_or_fit_model(spark, folder, LinearSVCModel, fit)
    scored = cut_lineage(decision_scores(model, mapped(test)).select("label", "score", "prediction"))
    cells = binary_confusion(scored, "label", "prediction")
    both = with_row(with_row(cells, auc_trapezoid(scored, "label", "score")), auc_trapezoid(scored, "label", "prediction").withColumnRenamed("auc", "auc_labels"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return both.select(
        F.lit(best["kernel"]).alias("kernel"),
        F.lit(best["c"]).alias("c"),
        F.lit(best["gamma"]).cast("double").alias("gamma"),
        F.lit(best["accuracy"]).alias("cv_accuracy"),
        F.when(n > 0, (F.col("tn") + F.col("tp")) / n).alias("accuracy"),
        "auc", "auc_labels", "tn", "fp", "fn", "tp",
    )


def forest_best(model: CrossValidatorModel, trees: Sequence[int], test: DataFrame) -> DataFrame:
    """(trees, cv_accuracy, accuracy, errors, n): the best forest of a grid, which is fitted on all train rows, on the hold-out."""
    at = max(range(len(trees)), key=lambda i: model.avgMetrics[i])
    e = error_rate(model.bestModel.transform(test), "prediction", "label")
    cv = float(model.avgMetrics[at])
    return e.select(F.lit(int(trees[at])).alias("trees"), F.lit(cv).alias("cv_accuracy"), (1 - F.col("rate")).alias("accuracy"), "errors", "n")


def compare_embeddings(
    docs: DataFrame, key: str, label: str, fit: Fit, models: dict[str, Embed], passes: Sequence[int], pct_test: int = 20, infer_every: int | None = 5
) -> DataFrame:
    """(model, pass, error_rate, errors, n, best_so_far), one row per model and number of passes.

    ``fit`` trains word vectors on documents in a number of passes; ``models`` maps a name to (trained, documents)
    -> (key, docvec). One training serves all models of a pass. It sees the texts, not the labels, of all documents;
    a classifier learns from the train part and is judged on the rest. After the first and each ``infer_every``-th
    pass, rows named ``<model>_inferred`` follow: their vectors come from a training that has not seen the test
    texts. ``best_so_far`` marks the runs of a model that no earlier one beat. Each run leaves one row of numbers
    on the driver. See best_by_metric and rank_runs for what follows.
    """
    rows = []
    train, _ = train_test(docs, [key], pct_test)
    truth = docs.select(key, F.col(label).cast("double").alias("label"))
    for p in passes:
        seen = [("", docs)]
        if infer_every and (p == 1 or p % infer_every == 0):
            seen.append(("_inferred", train))
        for suffix, texts in seen:
            trained = fit(texts, p)
            for name, embed in models.items():
                vecs = with_vector(embed(trained, docs), "docvec").select(key, "features")
                fit_rows, test_rows = train_test(cut_lineage(truth.join(vecs, key)), [key], pct_test)
                scored = positive_probability(logistic().fit(fit_rows), test_rows)
                e = error_rate(scored, "probability_1", "label").first()
                rows.append((name + suffix, p, e["rate"], e["errors"], e["n"]))
    runs = docs.sparkSession.createDataFrame(rows, "model string, pass int, error_rate double, errors bigint, n bigint")
    so_far = F.min("error_rate").over(W.partitionBy("model").orderBy("pass"))
    return runs.withColumn("best_so_far", F.col("error_rate") <= so_far)
