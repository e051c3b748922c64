"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: ``python tests/oracle_harness.py [sf_dir] [name ...]``
Rows are compared order-insensitively after sorting columns by name;
floats are compared after rounding to 6 places.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from railyard.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm_val(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm_val(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm_val(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted(tuple(_norm_val(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], out


def compare(spark, name, fn, sql, sf_dir, con=None, verbose=True):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = rows_of(s_cols, s_rows)
    dc, dr = rows_of(d_cols, d_rows)
    ok = sc == dc and sr == dr
    msg = f"{name}: spark={len(sr)} duck={len(dr)} {'OK' if ok else 'MISMATCH'} ({t1 - t0:.1f}s)"
    if not ok and verbose:
        if sc != dc:
            msg += f"\n  cols spark={sc}\n  cols duck ={dc}"
        else:
            ss, ds = set(sr), set(dr)
            for r in list(ss - ds)[:3]:
                msg += f"\n  spark only: {str(r)[:400]}"
            for r in list(ds - ss)[:3]:
                msg += f"\n  duck only : {str(r)[:400]}"
    return ok, msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from railyard.session import local_session
    from railyard.plans.registry import oracle_sql, queries
    spark = local_session()
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in (names or list(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print(f"{name}: rows-only {df.count()}")
            continue
        try:
            ok, msg = compare(spark, name, qs[name], sqls[name], sf_dir, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:800]}"
        print(msg, flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
