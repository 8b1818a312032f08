"""Compare every query with its SQL statement on the same folder.

    python tests/parity.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"bool:{v}"
    if isinstance(v, float):
        return f"{v + 0.0!r}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return f"{v}"


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = canonical(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    actual = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        return f"{len(wrong)} of {len(actual)} rows differ, e.g. {wrong[0]}"
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("curbsight")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), connect(sf_dir), 0
    statements = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            if name in statements:
                problem = compare(df, con, statements[name])
                note = "equal" if problem is None else f"DIFFERS {problem}"
            else:
                problem, note = None, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem, note = str(e), f"FAILED {str(e)[:600]}"
        bad += problem is not None
        print(f"{name:26s} {time.time() - began:7.1f}s {note}", flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
