"""Run catalog queries next to DuckDB on the same parquet files and compare whole results.

usage: python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from motiontables.plans.registry import full_catalog  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is not None, str(type(v)), v) for v in t))


def compare(spark, con, name, query, sql, base):
    started = time.time()
    df = query(spark, base)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return "rows-only" if mine[1] else "EMPTY", took, f"{len(mine[1])} rows"
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return "COLUMNS", took, f"{mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return "COUNT", took, f"{len(mine[1])} vs {len(theirs[1])}"
    if mine[1] != theirs[1]:
        bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
        return "VALUES", took, f"{len(bad)} differ, columns {mine[0]}, e.g. {bad[0]}"
    return "ok" if mine[1] else "EMPTY", took, f"{len(mine[1])} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    base = f"/root/testdata/sf{args.sf}"
    cat = full_catalog()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    spark = session()
    failures = 0
    for name, query in cat.queries.items():
        if args.names and name not in args.names:
            continue
        try:
            status, took, note = compare(spark, con, name, query, cat.sql.get(name), base)
        except Exception as error:  # report and go on with the next query
            status, took, note = "ERROR", 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        failures += status not in ("ok", "rows-only")
        print(f"{status:10} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{failures} failures")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
