"""Run registered queries against their DuckDB twins and compare row count,
column names and order-insensitive values (the driver's gate, locally).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), sorted(cols)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t2 = time.time()
    s_vals, s_cols = rows_of(sdf.columns, srows)
    d_vals, d_cols = rows_of(dcols, drows)
    ok_cols = s_cols == d_cols
    ok_n = len(s_vals) == len(d_vals)
    ok_v = s_vals == d_vals
    detail = ""
    if not ok_cols:
        detail = f"cols spark={s_cols} duck={d_cols}"
    elif not ok_v:
        sset, dset = set(s_vals), set(d_vals)
        only_s = sorted(sset - dset)[:3]
        only_d = sorted(dset - sset)[:3]
        detail = f"spark-only={only_s} duck-only={only_d}"
    return ok_cols and ok_n and ok_v, len(s_vals), len(d_vals), t1 - t0, t2 - t1, detail


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from storylens.session import get_session

    spark = get_session(shuffle_partitions=8)
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(q):
        if name not in o:
            t0 = time.time()
            n = q[name](spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s, no oracle)", flush=True)
            continue
        try:
            ok, ns, nd, ts, td, detail = compare(spark, con, name, q[name], o[name], sf_dir)
        except Exception as e:  # report and continue
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        bad += 0 if ok else 1
        print(f"{'OK   ' if ok else 'FAIL '} {name}: spark={ns} duck={nd} ({ts:.1f}s/{td:.1f}s) {detail}", flush=True)
    print(f"{bad} failing", flush=True)


if __name__ == "__main__":
    main()
