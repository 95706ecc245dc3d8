"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Mirrors the driver's correctness gate: same column names, same row count and
the same multiset of rows (order-insensitive).  Usage::

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from carelake.sources.tables import DRIVER_TABLES, table_path  # noqa: E402


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf_dir, name, query, sql, con, verbose=True):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rec = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "spark_rows": len(s_rec), "sec": round(t1 - t0, 2)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rec = res.fetchall()
    out = {"name": name, "spark_rows": len(s_rec), "oracle_rows": len(d_rec), "sec": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"columns spark={s_cols} oracle={d_cols}")
        return out
    a, b = _rows(s_cols, s_rec), _rows(d_cols, d_rec)
    if a == b:
        out["ok"] = True
        return out
    out["ok"] = False
    sa, sb = set(a), set(b)
    only_s = [r for r in a if r not in sb][:3]
    only_d = [r for r in b if r not in sa][:3]
    out["why"] = f"cols={sorted(s_cols)} only_spark={only_s} only_oracle={only_d}"
    return out


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    import __spark_entry__ as entry
    from carelake.session import build_session

    spark = build_session("local[8]")
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck_connection(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as exc:  # report and keep going
            r = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:600]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
