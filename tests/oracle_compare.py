"""Run registered queries against their DuckDB oracles (like the driver's check).

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokenmill.plans.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con, limit: float = 240.0) -> tuple[bool, str]:
    import threading

    t0 = time.time()
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        sdf = fn(spark, sf_dir)
        srows = [tuple(r) for r in sdf.collect()]
    finally:
        timer.cancel()
    t1 = time.time()
    scols = sdf.columns
    if sql is None:
        return True, f"rows-only: {len(srows)} rows spark {t1 - t0:.1f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(dcols, drows)
    if ac != bc:
        return False, f"columns differ: spark={ac} duck={bc}"
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({len(a)} rows), first: {diff}"
    return True, f"{len(a)} rows ok spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as E
    from tokenmill.session import local_session

    spark = local_session(8, 8)
    qs, oracles = E.queries(), E.oracle_sql()
    names = args or sorted(qs)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, sf_dir, n, qs[n], oracles.get(n), con)
        except Exception as e:  # report and continue
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {n}: {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
