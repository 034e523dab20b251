"""Run registered Spark queries next to their DuckDB SQL twins and compare.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]

Comparison: row count, column names, and the order-insensitive multiset of
rows with columns sorted by name. ``strict`` compares exact values (floats by
repr); ``close`` allows a relative float difference of 1e-9.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def rows_of(names, rows, digits=None):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    out.sort(key=_key)
    return [names[i] for i in order], out


def compare(spark, sf_dir, key, fn, sql, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_names = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    d_names = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    res["oracle_rows"] = len(d_rows)
    sn, sr = rows_of(s_names, s_rows)
    dn, dr = rows_of(d_names, d_rows)
    if sn != dn:
        res["status"] = f"COLUMNS DIFFER spark={sn} oracle={dn}"
        return res
    if len(sr) != len(dr):
        res["status"] = "ROWCOUNT DIFFER"
    elif sr == dr:
        res["status"] = "match"
    else:
        _, sr9 = rows_of(s_names, s_rows, 9)
        _, dr9 = rows_of(d_names, d_rows, 9)
        res["status"] = "close (float digits)" if sr9 == dr9 else "VALUES DIFFER"
    if res["status"] not in ("match",):
        sset, dset = set(sr), set(dr)
        res["only_spark"] = [r for r in sr if r not in dset][:3]
        res["only_oracle"] = [r for r in dr if r not in sset][:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from ledgerlens.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in keys or list(qs):
        try:
            res = compare(spark, sf_dir, key, qs[key], sqls.get(key), con)
        except Exception as exc:  # report and continue with the next query
            res = {"key": key, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if res["status"] not in ("match", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
