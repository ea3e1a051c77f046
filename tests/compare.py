"""Runs queries and their DuckDB statements side by side.

python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def difference(found: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs, as text; rows are compared regardless of their order."""
    columns = sorted(found.columns)
    if columns != sorted(expected.columns):
        return f"columns {columns} != {sorted(expected.columns)}"
    if len(found) != len(expected):
        return f"{len(found)} rows != {len(expected)}"
    found = found[columns].sort_values(columns, ignore_index=True)
    expected = expected[columns].sort_values(columns, ignore_index=True)
    for c in columns:
        a, b = found[c], expected[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}, row {i}: {str(a[i])[:300]} != {str(b[i])[:300]} ({(~same).sum()} rows)"
        if a.dtype != b.dtype:
            return f"{c}: type {a.dtype} != {b.dtype}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = database(sf_dir), entry.oracle_sql()
    bad = 0
    for name in names:
        begin = time.time()
        try:
            found = entry.queries()[name](spark, sf_dir).toPandas()
            spent = time.time() - begin
            problem = difference(found, con.execute(sql[name]).df()) if name in sql else "no statement"
        except Exception as error:  # report and go on
            spent, found, problem = time.time() - begin, [], f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        both = time.time() - begin
        verdict = "ok " if problem is None else "BAD"
        print(f"{verdict} {name} {len(found)} rows {spent:.1f}s / {both - spent:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
