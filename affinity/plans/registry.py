"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0).cast("double")


def s6(expr: str) -> str:
    """SQL form of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


# Views over the given tables, stated in SQL (see affinity.sources.tables for the Spark side).
RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(1 + SUM(CAST(l_quantity AS BIGINT)) % 5 AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
BRAND = """ratings AS (
  SELECT o_custkey AS user_id, CAST(substr(p_brand, 7) AS BIGINT) AS item_id,
         CAST(1 + SUM(CAST(l_quantity AS BIGINT)) % 5 AS DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
REVIEWS = f"""{RATINGS}, reviews AS (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS "reviewerID",
         'B' || lpad(CAST(item_id AS VARCHAR), 9, '0') AS asin, rating AS overall FROM ratings)"""
ITEM_EVENTS = """item_events AS (
  SELECT user_id, event_type, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item
  FROM events WHERE event_type IN ('view', 'purchase'))"""
VIEWBUY = f"""{ITEM_EVENTS}, viewed AS (
  SELECT DISTINCT a.item, b.item AS other FROM item_events a JOIN item_events b USING (user_id)
  WHERE a.event_type = 'view' AND b.event_type = 'view' AND a.item <> b.item),
bought AS (
  SELECT DISTINCT a.item, b.item AS other FROM item_events a JOIN item_events b USING (user_id)
  WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND a.item <> b.item),
attrs AS (
  SELECT p_partkey AS item,
         CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price,
         CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand FROM part)"""
TEXTS = """texts AS (SELECT doc_id, text, CAST(quality AS BIGINT) AS label FROM documents JOIN labels USING (doc_id))"""
