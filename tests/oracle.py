"""Compare queries with their SQL, run by DuckDB on the same files.

As a script: ``python tests/oracle.py <sf_dir> [name or prefix* ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodgeframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else float(repr(v))
    return v


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[str | None, int]:
    """What differs, if anything, and the number of rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _sorted_rows(names, result.fetchall())
    actual = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}", len(actual)
    if len(actual) != len(expected):
        return f"{len(actual)} rows instead of {len(expected)}", len(actual)
    for a, e in zip(actual, expected):
        if [type(x) for x in a] != [type(x) for x in e] or a != e:
            return f"{sorted(names)}\n   got {a}\n   not {e}", len(actual)
    return None, len(actual)


def main(sf_dir: str, wanted: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark, con = session(), connect(sf_dir)
    sql = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and not any(
            name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted
        ):
            continue
        began = time.time()
        try:
            if name in sql:
                problem, n = difference(run(spark, sf_dir), con, sql[name])
            else:
                problem, n = None, len(run(spark, sf_dir).collect())
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        state = "ok  " if problem is None else "FAIL"
        note = "" if name in sql else " (rows only)"
        print(f"{state} {name}: {n} rows, {time.time() - began:.2f} s{note}", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
