"""Compare registered queries with their SQL: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import collections
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.environ.get("TESTDATA_ROOT", "/root/testdata")


def session(cpus: str = "8", partitions: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickloom-tests")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], collections.Counter(repr(tuple(_plain(r[i]) for i in order)) for r in data)


def compare(spark, con, run, sql, folder):
    started = time.time()
    df = run(spark, folder)
    data = df.collect()
    seconds = time.time() - started
    left_names, left = rows_of(df.columns, data)
    if sql is None:
        return len(data), seconds, None
    cur = con.execute(sql)
    right_names, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_names != right_names:
        return len(data), seconds, f"columns {left_names} != {right_names}"
    if left != right:
        only_left, only_right = left - right, right - left
        return len(data), seconds, (
            f"{sum(only_left.values())} rows only in Spark, {sum(only_right.values())} only in SQL\n"
            f"   cols  {left_names}\n"
            + "\n".join(f"   spark {k}" for k in sorted(only_left)[:3])
            + "\n"
            + "\n".join(f"   sql   {k}" for k in sorted(only_right)[:3])
        )
    return len(data), seconds, ""


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    import __spark_entry__ as entry

    folder = f"{ROOT}/sf{sf}"
    spark = session()
    con = duck(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            n, seconds, verdict = compare(spark, con, run, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            text = str(error)
            print(f"ERROR {name}: {type(error).__name__}: {text[:1500]}", flush=True)
            bad += 1
            continue
        mark = "rows " if verdict is None else "ok   " if verdict == "" else "DIFF "
        bad += bool(verdict)
        print(f"{mark} {name:42s} rows={n:7d} {seconds:6.2f}s {verdict or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
