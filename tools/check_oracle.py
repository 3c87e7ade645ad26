"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

usage: python tools/check_oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crossweave.plans.registry import load_all  # noqa: E402
from crossweave.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.6f}") + 0.0
    if isinstance(v, bool):
        return int(v)
    return v


def key(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def compare(name, sdf, con, sql):
    t0 = time.time()
    cols = sorted(sdf.columns)
    srows = [tuple(norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows_raw = cur.fetchall()
    t2 = time.time()
    if sorted(dcols) != cols:
        return f"COLUMNS spark={cols} duck={sorted(dcols)}", t1 - t0, t2 - t1
    types = []
    for f in sdf.schema.fields:
        st, dt = f.dataType.simpleString(), dtypes[f.name].upper()
        group = lambda t: "int" if any(x in t for x in ("INT",)) and "INTERVAL" not in t else (
            "double" if "DOUBLE" in t or "FLOAT" in t else ("str" if "CHAR" in t or "STRING" in t else t))
        if group(st.upper()) != group(dt) or "HUGEINT" in dt or "DECIMAL" in dt:
            types.append((f.name, st, dt))
    if types:
        return f"TYPES {types}", t1 - t0, t2 - t1
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(norm(r[i]) for i in idx) for r in drows_raw]
    if len(srows) != len(drows):
        return f"ROWS spark={len(srows)} duck={len(drows)}", t1 - t0, t2 - t1
    srows.sort(key=key)
    drows.sort(key=key)
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"VALUES {len(bad)}/{len(srows)} first={dict(zip(cols, a))} diff={diff}", t1 - t0, t2 - t1
    nulls = [c for i, c in enumerate(cols) if srows and all(r[i] is None for r in srows)]
    note = f" all-null: {nulls}" if nulls else ""
    return f"ok {len(srows)} rows{note}", t1 - t0, t2 - t1


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--covers", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    d = f"/root/testdata/sf{args.sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    fails = 0
    for name, q in load_all().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            t0 = time.time()
            sdf = q.run(spark, d)
            plan = time.time() - t0
            if q.sql is None:
                t0 = time.time()
                n = sdf.count()
                msg, ts, td = f"rows-only {n}", time.time() - t0, 0.0
            else:
                msg, ts, td = compare(name, sdf, con, q.oracle())
            ts += plan
        except Exception as e:  # noqa: BLE001
            msg, ts, td = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, 0.0
        good = msg.startswith(("ok", "rows-only"))
        fails += not good
        print(f"{'PASS' if good else 'FAIL'} {name:38s} spark {ts:6.2f}s duck {td:5.2f}s  {msg}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
