"""Runs registered queries against their SQL twins; usage: python tests/compare.py [sf] [name ...]"""

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def check(spark, con, sf, name, query, sql):
    t0 = time.time()
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL", t1 - t0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", t1 - t0
    if got != want:
        only_s = [r for r in got if r not in set(want)][:4]
        only_d = [r for r in want if r not in set(got)][:4]
        return False, f"rows {len(got)} vs {len(want)}\n   spark {only_s}\n   sql   {only_d}", t1 - t0
    return True, f"{len(got)} rows", t1 - t0


if __name__ == "__main__":
    from hoptrail.session import local_session
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "/root/testdata/sf" + (args.pop(0) if args and args[0][0].isdigit() else "0.001")
    spark, con = local_session(), connect(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = []
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or
             q[n].__module__.endswith("." + a) for a in args)]
    for n in names:
        try:
            ok, msg, sec = check(spark, con, sf, n, q[n], o.get(n))
        except Exception as ex:
            ok, msg, sec = False, type(ex).__name__ + " " + str(ex)[:600], 0
        flag = "" if ok and not msg.startswith("0 rows") else ("  <<<<" if not ok else "  <<<< EMPTY")
        print(f"{n:28s} {sec:6.2f}s {msg}{flag}", flush=True)
        if not ok:
            bad.append(n)
    print("FAILED", len(bad), bad, "of", len(names))
