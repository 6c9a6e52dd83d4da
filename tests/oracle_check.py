"""Compare registered queries with their SQL on the given tables.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from voxelfield.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return ("", "null")
        if isinstance(v, bool):
            return ("b", str(v))
        if isinstance(v, (int, float)):
            return ("n", f"{float(v):.6f}")
        return ("s", str(v))

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str) -> str:
    """Empty if equal, else a short account of the difference."""
    df = entry.queries()[name](spark, sf)
    ours = [tuple(r) for r in df.collect()]
    text = entry.oracle_sql().get(name)
    if text is None:
        return "" if ours else "no rows"
    result = con.execute(text)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(ours, df.columns), canonical(theirs, columns)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(sf)
    failed = 0
    for name in args or entry.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(verdict)
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if not verdict else 'FAIL'} {time.time() - start:6.1f}s {kind:4s} {name} {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
