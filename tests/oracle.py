"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return repr(float(value)) if isinstance(value, decimal.Decimal) else str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    return str(value)


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str | None:
    """None if both results hold the same rows, else what differs."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    order = sorted(spark_cols)
    left = sorted(tuple(_plain(r[spark_cols.index(c)]) for c in order) for r in spark_rows)
    right = sorted(tuple(_plain(r[sql_cols.index(c)]) for c in order) for r in sql_rows)
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows != {len(right)} rows; {extra}"
    off = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(off)} rows differ of {len(left)} {order}: {off[:3]}" if off else None


def run(spark, con, name, folder: str = SF_DIR) -> tuple[str | None, int, float]:
    from plumbline.plans import suite

    began = time.time()
    df = suite.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    sql = suite.ORACLES.get(name)
    if sql is None:
        return None, len(rows), took
    cursor = con.execute(sql)
    cols = [d[0] for d in cursor.description]
    return compare(rows, df.columns, cursor.fetchall(), cols), len(rows), took


if __name__ == "__main__":
    from plumbline.plans import suite
    from plumbline.session import build_session

    suite.load()
    folder = SF_DIR
    names = sys.argv[1:] or list(suite.QUERIES)
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    picked = [n for n in suite.QUERIES if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    for name in picked:
        try:
            problem, n, took = run(spark, con, name, folder)
            print(f"{'ok  ' if problem is None else 'DIFF'} {name} rows={n} {took:.1f}s {'(rows only)' if name not in suite.ORACLES else ''} {(problem or '')[:1500]}", flush=True)
        except Exception as error:
            print(f"FAIL {name} {type(error).__name__} {str(error)[:1200]}", flush=True)
