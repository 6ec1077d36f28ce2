"""Writers, run log, model store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession

from affinity.session import scratch_dir  # noqa: F401


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, as many files as there are partitions."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_run_log(runs: DataFrame, path: str) -> None:
    """Add metric rows to the run log; runs never overwrite each other."""
    runs.write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def get_or_fit_model(
    spark: SparkSession, path: str, model_type: type[MLReadable], fit: Callable[[], MLWritable]
) -> MLWritable:
    """The saved model if there is a complete one, else fit and save. The path may be on any shared file system."""
    if path_exists(spark, f"{path}/metadata/_SUCCESS"):
        return model_type.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model
