"""Surrogate ids and integer codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.scale import grouped_index, hash_bucket, range_bucket


def id_map(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): dense ids 0..n-1 over the distinct values, in md5 order.

    md5 order spreads any key evenly over the buckets, so ids are made without a global sort.
    """
    keys = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return grouped_index(keys, [], hash_bucket(F.col(col)), [F.md5(F.col(col)), F.col(col)], out)


def join_ids(df: DataFrame, maps: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Inner-join facts to id maps. A map has one row per key, so a hot key only makes the fact side
    large, which the runtime skew join splits; small maps are broadcast at runtime by their size."""
    for m, key in maps:
        df = df.join(m, key)
    return df


def assign_ids(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Replace string keys by dense long ids: ``{"user_id_str": "user_id", ...}``."""
    return join_ids(df, [(id_map(df, c, out), c) for c, out in cols.items()]).drop(*cols)


def code_map(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): position of each distinct value in sorted order."""
    keys = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return grouped_index(keys, [], range_bucket(keys, col), [F.col(col)], out)


def label_encode(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Sorted-order integer codes added for several columns; nulls get a null code."""
    for c, out in cols.items():
        df = df.join(code_map(df, c, out), c, "left")
    return df
