"""Side-by-side check of Spark queries against their DuckDB oracles.

Mirrors the driver's comparison: row count, column names, and an
order-insensitive hash of the values (floats compared after rounding).
Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    import datetime

    import numpy as np
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    ok_n = len(srows) == len(drows)
    ok_v = ok_cols and ok_n and rows_of(scols, srows) == rows_of(dcols, drows)
    status = "OK " if ok_v else "BAD"
    print(f"{status} {name}: spark {len(srows)} rows {t1 - t0:.1f}s, duck {len(drows)} rows; cols_ok={ok_cols}",
          flush=True)
    if not ok_v:
        if not ok_cols:
            print("   spark cols", sorted(scols), "\n   duck cols ", sorted(dcols))
        else:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            sa, sb = set(a), set(b)
            diff_a = [r for r in a if r not in sb][:3]
            diff_b = [r for r in b if r not in sa][:3]
            print("   spark-only", diff_a, "\n   duck-only ", diff_b)
    return ok_v


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from riskloom.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        if name not in sqls:
            t0 = time.time()
            try:
                n = fn(spark, sf_dir).count()
                print(f"R   {name}: {n} rows (no oracle) {time.time() - t0:.1f}s", flush=True)
            except Exception as e:  # noqa: BLE001
                print(f"ERR {name}: {type(e).__name__}: {str(e)[:400]}")
                bad.append(name)
            continue
        try:
            if not compare(spark, con, name, fn, sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:600]}")
            bad.append(name)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
