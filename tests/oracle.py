"""Compare a registered query with its SQL text on DuckDB: columns, row count and values."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(normal(row[n]) for n in order) for row in data), key=repr)


def compare(spark, connection, function, sql: str, folder: str) -> tuple[str | None, float, int]:
    """An explanation of the first difference, or None."""
    started = time.time()
    frame = function(spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - started
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", seconds, len(got)
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; e.g. {set(got) ^ set(expected) and list(set(got) ^ set(expected))[:3]}", seconds, len(got)
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} != {b}", seconds, len(got)
    return None, seconds, len(got)


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as driver

    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, connection = session(), connect(folder)
    for name, function in driver.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        sql = driver.oracle_sql().get(name)
        try:
            if sql is None:
                started = time.time()
                print(f"rows-only {name}: {function(spark, folder).count()} rows {time.time() - started:.2f}s", flush=True)
            else:
                problem, seconds, count = compare(spark, connection, function, sql, folder)
                print(f"{'ok  ' if problem is None else 'FAIL'} {name}: {count} rows {seconds:.2f}s {(problem or '')[:600]}", flush=True)
        except Exception as error:
            print(f"ERROR {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
