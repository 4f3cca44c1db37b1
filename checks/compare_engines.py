"""Run queries on Spark and their SQL on DuckDB over the same tables and compare every value.

python -m checks.compare_engines [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks import ORACLES, QUERIES, load_all
from fairtag.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}"
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in ORACLES:
        return len(rows) > 0, f"rows only: {len(rows)} rows, {took:.1f}s"
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    have, want = canonical(df.columns, rows), canonical(columns, wanted)
    if have == want:
        return True, f"{len(rows)} rows, {took:.1f}s"
    only = [r for r in have if r not in set(want)][:2]
    missing = [r for r in want if r not in set(have)][:2]
    return False, f"{len(have)} against {len(want)} rows\n  spark {only}\n  duck  {missing}"


def main(prefixes: list[str]) -> int:
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    load_all()
    spark = local_session("compare-engines", 8)
    con = duck(sf)
    failed = []
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as error:  # report every query, not only the first failure
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
