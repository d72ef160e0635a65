"""Compare registered queries with DuckDB: python oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from scholia import plans
from scholia.plans.views import BASE
from scholia.session import local_session


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, sf_dir, queries, oracle):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in oracle:
        return f"{name:24s} rows-only rows={len(got):8d} spark={t1 - t0:6.1f}s"
    cur = con.execute(oracle[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    head = f"rows={len(got):8d}/{len(want):8d} spark={t1 - t0:6.1f}s duck={t2 - t1:6.1f}s"
    if sorted(cols) != sorted(df.columns):
        return f"{name:24s} COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"{name:24s} {'ok' if got else 'EMPTY'} {head}"
    sa, sb = set(a), set(b)
    return (f"{name:24s} MISMATCH {head} cols={sorted(cols)}\n   spark only {sorted(sa - sb, key=repr)[:3]}\n"
            f"   duck only  {sorted(sb - sa, key=repr)[:3]}")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracle = plans.load()
    names = sys.argv[2:] or list(queries)
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name in names:
        try:
            print(check(spark, con, name, sf_dir, queries, oracle), flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"{name:24s} ERROR {type(e).__name__} {str(e)[:900]}", flush=True)


if __name__ == "__main__":
    main()
