"""Side-by-side check of a named Spark query against its DuckDB oracle text.

Mirrors the driver's gate: same row count, same column names, same
order-insensitive multiset of values (columns sorted by name). Floats are
compared both exactly and to 9 significant digits.

Run as a script: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int | None):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if digits is None:
            return repr(v)
        return f"{v:.{digits}g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _rows(cols: list[str], rows: list[tuple], digits: int | None) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i], digits) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, spark_fn, sql: str) -> dict:
    t0 = time.time()
    sdf = spark_fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    t2 = time.time()
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "exact_match": _rows(s_cols, s_rows, None) == _rows(d_cols, d_rows, None) if sorted(s_cols) == sorted(d_cols) else False,
        "value_match": _rows(s_cols, s_rows, 9) == _rows(d_cols, d_rows, 9) if sorted(s_cols) == sorted(d_cols) else False,
        "spark_s": round(t1 - t0, 2),
        "duck_s": round(t2 - t1, 2),
    }
    if not out["columns_match"]:
        out["spark_cols"] = s_cols
        out["oracle_cols"] = d_cols
    elif not out["value_match"]:
        a = _rows(s_cols, s_rows, 9)
        b = _rows(d_cols, d_rows, 9)
        out["only_spark"] = [r for r in a if r not in b][:5]
        out["only_oracle"] = [r for r in b if r not in a][:5]
        out["sorted_cols"] = sorted(s_cols)
    return out


def main(argv: list[str]) -> int:
    from moderata.session import build_session

    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"{name:40s} rows-only rows={n}")
            continue
        r = compare(spark, con, name, sf_dir, qs[name], sqls[name])
        ok = r["value_match"]
        bad += not ok
        flag = "OK " if ok else "BAD"
        ex = "" if r["exact_match"] else " (float-inexact)"
        print(f"{flag} {name:40s} rows={r['spark_rows']}/{r['oracle_rows']} {r['spark_s']}s{ex}")
        if not ok:
            for k in ("spark_cols", "oracle_cols", "sorted_cols", "only_spark", "only_oracle"):
                if k in r:
                    print("    ", k, r[k])
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
