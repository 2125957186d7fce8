"""Run registered queries and their SQL twins side by side.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in values)


def compare(df, con, sql):
    """(error or None, number of rows, seconds of Spark, seconds of SQL)."""
    start = time.time()
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    end = time.time()
    error = None
    if sorted(df.columns) != sorted(names):
        error = f"columns {sorted(df.columns)} against {sorted(names)}"
    elif got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        error = f"{len(got)} rows against {len(want)}; only here {extra}; only in SQL {lack}"
    return error, len(got), middle - start, end - middle


if __name__ == "__main__":
    import __spark_entry__ as e
    from shelfmark.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    sql = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            error, n, a, b = compare(fn(spark, folder), con, sql[name])
        except Exception as ex:
            error, n, a, b = f"{type(ex).__name__}: {str(ex)[:600]}", -1, 0, 0
        bad += bool(error)
        print(f"{'BAD ' if error else 'ok  '} {name} rows={n} spark={a:.2f}s sql={b:.2f}s {error or ''}", flush=True)
    print("bad:", bad)
