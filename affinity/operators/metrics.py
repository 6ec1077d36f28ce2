"""Error, ranking and classifier metrics, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.functions.columns import nullif0
from affinity.operators.scale import grouped_sums, range_bucket, with_row


def rmse(df: DataFrame, pred: str = "prediction", actual: str = "rating") -> DataFrame:
    err = F.col(pred) - F.col(actual)
    return df.agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def mae(df: DataFrame, pred: str = "prediction", actual: str = "rating") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"))


def errors(df: DataFrame, *by: str, pred: str = "prediction", actual: str = "rating") -> DataFrame:
    """RMSE, MAE and count in one pass, per group if asked."""
    err = F.col(pred) - F.col(actual)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.count(err).alias("n")
    )


def mean_auc(counts: DataFrame) -> DataFrame:
    """Mean over users of won pairs / pairs, from (user_id, total, correct)."""
    auc = F.col("correct").cast("double") / nullif0(F.col("total"))
    return counts.agg(F.count(auc).alias("n_users"), F.avg(auc).alias("mean_auc"))


def accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    hit = (F.col(pred) == F.col(label)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def error_rate(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Rounded prediction against the label: errors, rows, rate."""
    miss = (F.rint(F.col(pred)) != F.col(label)).cast("bigint")
    out = df.agg(F.sum(miss).alias("errors"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rate", F.col("errors").cast("double") / nullif0(F.col("n")))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp in one row."""

    def cell(a: int, p: int) -> Column:
        return F.count_if((F.col(label) == a) & (F.col(pred) == p))

    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp): per distinct score, rows at and above it, from the highest score down.

    Rows are first counted per distinct score, so ties of any size are one row; the running sums go
    score range by score range and only the range totals meet in one place.
    """
    y = F.col(label)
    per = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    return grouped_sums(
        per, [], range_bucket(per, "score"), [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, ascending=False
    )


def binned(df: DataFrame, score: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Scores rounded down to one of ``bins`` equal steps, for a curve with a bounded number of points."""
    step = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(score) - lo) / step), F.lit(0)), F.lit(bins - 1))
    return df.withColumn(score, F.lit(lo) + b * F.lit(step))


def _class_totals(per: DataFrame) -> DataFrame:
    return per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score. Null rates when a class is missing.

    The curve starts at (0, 0), which needs no row.
    """
    per = score_table(df, label, score)
    return with_row(per, _class_totals(per)).select(
        F.col("score").alias("threshold"),
        (F.col("fp").cast("double") / nullif0(F.col("n"))).alias("fpr"),
        (F.col("tp").cast("double") / nullif0(F.col("p"))).alias("tpr"),
    )


def auc_trapezoid(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve: each score adds its negatives times the mean of the positives above
    and at it, which is the trapezoid rule without looking at the neighbouring row."""
    per = score_table(df, label, score)
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0))
    out = per.agg(area.alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select((F.col("a") / nullif0(F.col("p").cast("double") * F.col("n"))).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    per = score_table(df, label, score)
    return with_row(per, _class_totals(per)).select(
        F.col("score").alias("threshold"),
        (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp").cast("double") / nullif0(F.col("p"))).alias("recall"),
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the step in recall."""
    per = score_table(df, label, score)
    gain = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = per.agg(gain.alias("g"), F.sum("pos").alias("p"))
    return out.select((F.col("g") / nullif0(F.col("p"))).alias("average_precision"))


def micro_rows(df: DataFrame, label: str, scores: str) -> DataFrame:
    """One (label, score) row per class and row, for micro averages over an array of class scores."""
    one = df.select(F.col(label).alias("_y"), F.posexplode(scores).alias("_c", "score"))
    return one.select((F.col("_y") == F.col("_c")).cast("int").alias("label"), "score")
