"""Compare every registered query with its SQL: `python -m tests.oracle_check DIR [name ...]`."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[int, list[str]]:
    """Number of rows and a list of differences. Python workers and cross joins count as such."""
    got = entry_points.queries()[name](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    unwanted = re.findall("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", plan)
    want = con.execute(entry_points.oracle_sql()[name])
    want_columns, want_rows = _sorted_rows([d[0] for d in want.description], want.fetchall())
    got_columns, got_rows = _sorted_rows(got.columns, got.collect())
    problems = [f"plan has {unwanted}"] if unwanted else []
    if got_columns != want_columns:
        problems.append(f"columns {got_columns} != {want_columns}")
    if len(got_rows) != len(want_rows):
        problems.append(f"{len(got_rows)} rows != {len(want_rows)}")
    different = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if different:
        problems.append(f"{len(different)} rows differ, first: {different[0]}")
    return len(got_rows), problems


def main() -> int:
    from tests.conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry_points.queries())
    spark, con, failed = make_session(), connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            rows, problems = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} {time.time() - started:.2f}s", *problems, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
