"""Compare Spark queries with their DuckDB oracles.

Run as a script: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET threads TO 8")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(norm(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when both sides agree, else what differs."""
    got = query(spark, sf_dir)
    g_cols, g_rows = canon(got.columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return None if g_rows else "no rows"
    rel = con.sql(sql)
    w_cols, w_rows = canon(rel.columns, rel.fetchall())
    if g_cols != w_cols:
        return f"columns {g_cols} vs {w_cols}"
    if not g_rows:
        return "no rows on both sides" if not w_rows else "spark returned no rows"
    if len(g_rows) != len(w_rows):
        return f"rows {len(g_rows)} vs {len(w_rows)}\n  {g_rows[:2]}\n  {w_rows[:2]}"
    diff = [(a, b) for a, b in zip(g_rows, w_rows) if a != b]
    if diff:
        return f"{len(diff)} of {len(g_rows)} rows differ on {g_cols}: {diff[:2]}"
    return None


def main() -> None:
    from munim.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as exc:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(exc))[:1500]
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
