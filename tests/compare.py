"""Run registered queries next to their DuckDB text and report differences."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from cohortwise.sources.projection import BASE_TABLES  # noqa: E402


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{directory}/{name}.parquet')")
    return con


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order, with numbers as doubles and times as text."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else float(x)
        if x is None or isinstance(x, (bool, str)):
            return x
        return float(x) if isinstance(x, (int, Decimal)) else str(x)

    shaped = [tuple(value(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(shaped, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, build, sql: str | None, directory: str) -> tuple[str | None, int, float]:
    """(difference or None, rows, seconds)."""
    start = time.time()
    frame = build(spark, directory)
    collected = [tuple(row) for row in frame.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(collected), seconds
    names, rows = canonical(frame.columns, collected)
    result = con.execute(sql)
    want_names, want = canonical([c[0] for c in result.description], result.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}", len(rows), seconds
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:3]
        missing = [r for r in want if r not in set(rows)][:3]
        return f"{len(rows)} rows vs {len(want)}; {names}\n   extra {extra}\n   missing {missing}", len(rows), seconds
    return None, len(rows), seconds


def main(directory: str, pattern: str = "") -> int:
    from cohortwise import build_session
    import __spark_entry__ as entry

    spark = build_session(master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                          spark_driver_memory="12g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if pattern and not any(p in name for p in pattern.split(",")):
            continue
        try:
            problem, rows, seconds = compare(spark, con, build, oracles.get(name), directory)
        except Exception as error:  # keep going: the list of all problems is the point
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += problem is not None
        state = "DIFF" if problem else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:48} {rows:8} {seconds:7.2f}s {state}", problem or "", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
