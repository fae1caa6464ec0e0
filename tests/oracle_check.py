"""Run registered queries in Spark and their DuckDB oracles side by side.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from callsift.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    if v is None:
        return "None"
    try:
        import pandas as pd
        if v is pd.NaT:
            return "None"
    except Exception:
        pass
    return repr(v)


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SPARK ERROR {e}"[:400]); bad += 1; continue
        ts = time.time() - t0
        if name not in ors:
            print(f"{name:40s} rows={len(srows)} (no oracle) {ts:.1f}s"); continue
        t1 = time.time()
        try:
            cur = con.execute(ors[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} DUCKDB ERROR {e}"[:600]); bad += 1; continue
        td = time.time() - t1
        ok_cols = sorted(scols) == sorted(dcols)
        ok = ok_cols and canon(srows, scols) == canon(drows, dcols)
        print(f"{name:40s} {'OK ' if ok else 'BAD'} rows spark={len(srows)} duck={len(drows)} "
              f"{ts:.1f}s/{td:.1f}s" + ("" if ok_cols else f" cols {sorted(scols)} vs {sorted(dcols)}"))
        if not ok:
            bad += 1
            a, b = canon(srows, scols), canon(drows, dcols)
            sa, sb = set(a), set(b)
            print("   spark-only:", list(sa - sb)[:3])
            print("   duck-only: ", list(sb - sa)[:3])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
