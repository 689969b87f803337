"""Compare registered queries with their SQL counterpart on DuckDB.

    python -m tests.oracle [--sf 0.01] [key prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("cohortia-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, key, fn, sql, sf_dir):
    """(ok, message) for one query."""
    t = time.time()
    df = fn(spark, sf_dir)
    built = time.time() - t
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = f"build {built:.1f}s spark {time.time() - t:.1f}s"
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)} ({spent})"
    res = con.execute(sql)
    ocols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if cols != ocols:
        return False, f"columns {cols} != {ocols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, e.g. spark={bad[0][0]} sql={bad[0][1]}"
    return True, f"{len(got)} rows ({spent})"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--sql-only", action="store_true", help="leave out queries without SQL")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as e
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con, failed = session(), connect(sf_dir), 0
    oracles = e.oracle_sql()
    for key, fn in e.queries().items():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        if args.sql_only and key not in oracles:
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, key, fn, oracles.get(key), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - t:.2f}s {msg}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
