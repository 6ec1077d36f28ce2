"""Readers. Every one takes a schema or has a fixed one: inference would read the file twice."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = "reviewerID string, asin string, overall double, reviewText string"
RATING_SCHEMA = "user_id_str string, item_id_str string, rating double"
METADATA_SCHEMA = "asin string, price string, brand string, also_viewed string, buy_after_viewing string"
CORRUPT = "_corrupt"


def read_reviews_json(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_loose_json(
    spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA, parts: int | None = None, observation: Observation | None = None
) -> DataFrame:
    """Lines that are Python dict literals (single quotes, None, True, u'..'), often in one gz file.

    The lines are spread first, since gz is a single split. The JVM parses what reads as JSON with
    loose quotes; of the other lines the text goes to ``ast.literal_eval``, which evaluates literals and
    nothing else, in the same pass. Lines neither understands keep their text in ``_corrupt``. An ``observation``
    holds the numbers of lines (``lines``) and of those kept as text (``bad``) once the table has been used.
    """
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*st.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    lines = lines.repartition(parts or spark.sparkContext.defaultParallelism)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "true"}
    names = [f.name for f in st.fields]
    blank = (None,) * len(full)

    def parsed(line: str | None) -> tuple:
        if line is None:
            return blank
        try:
            d = ast.literal_eval(line)
            if isinstance(d, dict):
                return (*[d.get(n) for n in names], None)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
        return (*blank[:-1], line)

    @F.pandas_udf(full)
    def literal(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(v) for v in text], columns=[*names, CORRUPT], dtype=object)

    rows = lines.select("value", F.from_json("value", full, opts).alias("r"))
    failed = F.col(f"r.{CORRUPT}").isNotNull()
    # a line that has been parsed is a null to the fallback
    rows = rows.select("r", failed.alias("failed"), literal(F.when(failed, F.col("value"))).alias("l"))
    out = rows.select(*[F.when(F.col("failed"), F.col(f"l.`{n}`")).otherwise(F.col(f"r.`{n}`")).alias(n) for n in full.names])
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("lines"), F.count(CORRUPT).alias("bad"))
    return out


def read_ratings_csv(spark: SparkSession, path: str, header: bool = True, schema: str = RATING_SCHEMA) -> DataFrame:
    """Ratings with '?' for a missing value."""
    return spark.read.csv(path, schema=schema, header=header, nullValue="?")


def read_ratings_csv_noheader(spark: SparkSession, path: str) -> DataFrame:
    """The raw export: no header, a time stamp as fourth column, which is dropped."""
    return read_ratings_csv(spark, path, header=False, schema=RATING_SCHEMA + ", time_stamp bigint").drop("time_stamp")


def read_metadata_csv(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """Product metadata, all columns text, list cells quoted."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_binary_blobs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def _check_record_files(spark: SparkSession, path: str, size: int) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(p) if fs.exists(p) else []:
        if st.isFile() and not st.getPath().getName().startswith(("_", ".")) and st.getLen() % size:
            raise ValueError(f"{st.getPath()} has {st.getLen()} bytes, not a multiple of the {size}-byte record")


def read_feature_records(spark: SparkSession, path: str, key_len: int = 10, dim: int = 4096) -> DataFrame:
    """Fixed-width binary records: key_len bytes of id, then dim little-endian float32.

    Records are read as splits of the file, so one large file is many tasks; a file cut short is
    refused before any record is read.
    """
    size = key_len + 4 * dim
    _check_record_files(spark, path, size)
    raw = spark.createDataFrame(
        spark.sparkContext.binaryRecords(path, size).map(lambda b: (bytearray(b),)), "record binary"
    )

    @F.pandas_udf("array<float>")
    def floats(rec: pd.Series) -> pd.Series:
        return rec.map(lambda b: np.frombuffer(b, dtype="<f4", offset=key_len))

    key = F.rtrim(F.decode(F.substring("record", 1, key_len), "utf-8"))
    return raw.select(key.alias("asin"), floats("record").alias("features"))


def chunk_fixed_stride(seq: DataFrame, n: int, pos: str = "pos", value: str = "value") -> DataFrame:
    """A flat sequence of (key, n values) runs -> (rec, key, values). Each group has n + 1 rows."""
    g = seq.groupBy(F.floor(F.col(pos) / (n + 1)).alias("rec"))
    run = g.agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("run"))
    vals = F.transform("run", lambda x: x["v"])
    return run.select("rec", F.get(vals, F.lit(0)).alias("key"), F.slice(vals, 2, n).alias("values"))


def parse_vector_strings(df: DataFrame, label: str, features: str) -> DataFrame:
    """Text vectors -> (label, features array<double>)."""
    from affinity.functions.columns import vector_from_text

    return df.select(F.col(label).alias("label"), vector_from_text(F.col(features)).alias("features"))
