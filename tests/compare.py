"""Runs registered queries and their SQL twins and compares rows. Also usable as a script:
``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v) if isinstance(v, int) else str(v)


def rows_of(cols: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from affinity.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf), entry.queries(), entry.oracle_sql()
    fails = 0
    for name in names or qs:
        t0 = time.time()
        try:
            msg = compare(spark, con, qs[name], sqls.get(name), sf)
        except Exception as e:  # report and go on with the next query
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        fails += bool(msg)
        print(f"{'FAIL' if msg else 'ok':4} {name:28} {time.time() - t0:6.2f}s {'O' if name in sqls else 'R'} {msg}", flush=True)
    print(f"{fails} failures")
