"""Run a registered query on Spark and its SQL on DuckDB and compare the results."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulmark.plans.models import BASE_TABLES  # noqa: E402


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("haulmark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) < 1e-3 else f"{value:.9g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, build, sql: str | None) -> str:
    start = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    spark_s = time.time() - start
    if sql is None:
        return f"ROWS  {name} n={len(got)} spark={spark_s:.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_s = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"DIFF  {name} columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        ca, cb = set(a) - set(b), set(b) - set(a)
        return f"DIFF  {name} {len(a)} vs {len(b)} rows; spark only {sorted(ca)[:1]} sql only {sorted(cb)[:1]}"[:900]
    return f"OK    {name} n={len(a)} spark={spark_s:.1f}s sql={sql_s:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf)
    checks = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            print(compare(spark, con, sf, name, build, checks.get(name)), flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"FAIL  {name} {str(error)[:700]}", flush=True)
