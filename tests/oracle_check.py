"""Runs registered queries in Spark and their oracle SQL in DuckDB on the
same Parquet tables and compares row count, column names and an
order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, name, sf_dir, verbose=True):
    import __spark_entry__ as E

    t0 = time.time()
    df = E.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None, "sec": round(t1 - t0, 2)}
    dcols, drows = duck(sql, sf_dir)
    sh, sl = digest(scols, srows)
    dh, dl = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and sh == dh
    out = {"name": name, "ok": ok, "rows": (len(srows), len(drows)), "sec": round(t1 - t0, 2)}
    if not ok and verbose:
        out["cols"] = (sorted(scols), sorted(dcols))
        diff_s = sorted(set(sl) - set(dl))[:5]
        diff_d = sorted(set(dl) - set(sl))[:5]
        out["spark_only"] = diff_s
        out["duck_only"] = diff_d
    return out


if __name__ == "__main__":
    from plurality.session import local_session
    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = local_session(8)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:800]}
        if not r.get("ok", r.get("oracle", 1) is None):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
