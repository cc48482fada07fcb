"""Run registered queries on Spark and their SQL on DuckDB and compare rows. Usage: oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    from provspark.plans.fixtures import SOURCE_TABLES

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in SOURCE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return f"float:{v!r}"
    if isinstance(v, (int, str)):
        return f"{type(v).__name__}:{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"time:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols, rows = rows_of([d[0] for d in res.description], res.fetchall())
    if spark_cols != cols:
        return f"columns {spark_cols} != {cols}"
    if len(spark_rows) != len(rows):
        return f"rows {len(spark_rows)} != {len(rows)}; e.g. {list(set(spark_rows) ^ set(rows))[:3]}"
    diff = [(a, b) for a, b in zip(spark_rows, rows) if a != b]
    return f"{len(diff)} rows differ, e.g. spark {diff[0][0]} sql {diff[0][1]}" if diff else ""


def main(argv):
    import __spark_entry__ as entry
    from provspark.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or sorted(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                out = compare(df, con, oracles[name])
            else:
                out = "" if df.count() > 0 else "no rows"
            n = df.count() if argv[1:] else ""
        except Exception as exc:
            out = "ERROR " + str(exc)[:1500]
            n = "-"
            if argv[1:]:
                traceback.print_exc(limit=3)
        bad += bool(out)
        print(f"{name:28s} {'OK' if not out else 'FAIL'} {time.time() - start:6.2f}s {'' if name in oracles else '(rows only)'} {n} {out}",
              flush=True)
    print(f"{bad} failing of {len(argv[1:] or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
