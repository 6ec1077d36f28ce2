"""Projections, filters, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.columns import flag_not_null, list_elements
from affinity.operators.scale import grouped_index, range_bucket

RATING_COLUMNS = ("user_id_str", "item_id_str", "rating")


def select_ratings(df: DataFrame, cols: Sequence[str], names: Sequence[str] = RATING_COLUMNS) -> DataFrame:
    """Keep three columns and rename them by position."""
    return df.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop; names that are not there are ignored."""
    return df.drop(*names)


def cast_ratings(df: DataFrame) -> DataFrame:
    """Ids to bigint, rating to double; text that is not a number becomes null."""
    return df.select(
        F.expr("try_cast(user_id AS bigint)").alias("user_id"),
        F.expr("try_cast(item_id AS bigint)").alias("item_id"),
        F.expr("try_cast(rating AS double)").alias("rating"),
    )


def zero_base_ids(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c) - 1 for c in cols})


def filter_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def filter_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def filter_positive(df: DataFrame, col: str = "rating") -> DataFrame:
    return df.filter(F.col(col) > 0)


def with_flag(df: DataFrame, col: str, out: str) -> DataFrame:
    """0/1 label: is the column present?"""
    return df.withColumn(out, flag_not_null(F.col(col)))


def fill_null_const(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.fillna({col: value})


def explode_list_column(df: DataFrame, col: str, keep: Sequence[str], out: str) -> DataFrame:
    """One row per element of a list kept as text, with the carried columns."""
    return df.filter(F.col(col).isNotNull()).select(*keep, F.explode(list_elements(F.col(col))).alias(out))


def flatten_related(df: DataFrame, struct: str = "related") -> DataFrame:
    """Lift the fields of a nested struct to columns; rows without it keep nulls."""
    rest = [c for c in df.columns if c != struct]
    return df.select(*rest, f"{struct}.*")


def row_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Dense 0-based row number in the order of a unique key, without a one-task sort."""
    return grouped_index(df, [], range_bucket(df, key), [F.col(key)], out)


def sentence_tags(df: DataFrame, key: str, out: str = "tag") -> DataFrame:
    return row_index(df, key, "_i").withColumn(out, F.concat(F.lit("SENT_"), F.col("_i").cast("string"))).drop("_i")


def table_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values (null for maps, which have no equality).

    The exact form groups each column by its values and then counts the groups: a scan reads one column, and a frequent
    value is one row after the first step. The approximate form takes one pass, with a mergeable sketch per
    column, and is off by about two per cent.
    """
    fields = [(f.name, f.dataType.simpleString(), isinstance(f.dataType, T.MapType)) for f in df.schema.fields]
    if approximate:
        return _sketched_profile(df, fields)
    out: DataFrame | None = None
    for name, kind, is_map in fields:
        value = F.col(f"`{name}`")
        key = value.isNull().alias("_null") if is_map else value.alias("_v")
        groups = df.select(value.isNull().alias("_isnull"), key).groupBy(F.col("_isnull"), F.col("_null" if is_map else "_v"))
        per = groups.agg(F.count(F.lit(1)).alias("_n"))
        distinct = F.lit(None).cast("bigint") if is_map else F.count_if(~F.col("_isnull"))
        row = per.agg(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("_isnull"), F.col("_n"))), F.lit(0)).alias("nulls"),
            F.max(distinct).alias("distinct_values") if is_map else distinct.alias("distinct_values"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def _sketched_profile(df: DataFrame, fields: list[tuple[str, str, bool]]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, kind, is_map) in enumerate(fields):
        value = F.col(f"`{name}`")
        aggs.append(F.count_if(value.isNull()).alias(f"n{i}"))
        if not is_map:
            plain = value if kind in ("int", "bigint", "string") else F.xxhash64(F.when(value.isNotNull(), value))
            aggs.append(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(value.isNotNull(), plain))).alias(f"d{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col("rows"),
            F.col(f"n{i}").alias("nulls"),
            (F.lit(None).cast("bigint") if is_map else F.coalesce(f"d{i}", F.lit(0))).cast("bigint").alias("distinct_values"),
        )
        for i, (name, kind, is_map) in enumerate(fields)
    ]
    return one.select(F.inline(F.array(*rows)))


def feature_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Named numeric columns -> array<double>."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def ml_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Named numeric columns -> vector, for the learners."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in a stated order (top-k per task, then one merge of k rows)."""
    return df.orderBy(*order).limit(n)


def union_labeled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append two tables, columns matched by name."""
    return a.unionByName(b)
