"""Spark-vs-DuckDB comparison used by the tests (same checks as the driver:
row count, column names, order-insensitive value hash)."""

from __future__ import annotations

import hashlib
import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(tuple(v))
    if isinstance(v, dict):
        return _norm(tuple(v.values()))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def table_hash(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    lines = sorted("|".join(_norm(r[k]) for k in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_h = ok_cols and table_hash(s_cols, s_rows) == table_hash(d_cols, d_rows)
    return {"name": name, "rows_spark": len(s_rows), "rows_oracle": len(d_rows), "cols": ok_cols,
            "count": ok_n, "hash": ok_h, "s_cols": s_cols, "d_cols": d_cols,
            "s_rows": s_rows, "d_rows": d_rows}


def diff(res, limit=5):
    s_cols, d_cols = res["s_cols"], res["d_cols"]
    order_s = sorted(range(len(s_cols)), key=lambda k: s_cols[k])
    order_d = sorted(range(len(d_cols)), key=lambda k: d_cols[k])
    ss = {"|".join(_norm(r[k]) for k in order_s) for r in res["s_rows"]}
    dd = {"|".join(_norm(r[k]) for k in order_d) for r in res["d_rows"]}
    print("cols", sorted(s_cols))
    print("only spark:", sorted(ss - dd)[:limit])
    print("only oracle:", sorted(dd - ss)[:limit])


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from roadlens.session import get_spark
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = get_spark()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = []
    for name in qs:
        if only and name not in only:
            continue
        if name not in os_:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only {n}")
            continue
        try:
            r = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:300]}")
            bad.append(name)
            continue
        flag = "OK " if (r["cols"] and r["count"] and r["hash"]) else "BAD"
        print(f"{name:28s} {flag} rows {r['rows_spark']}/{r['rows_oracle']} cols={r['cols']} hash={r['hash']}")
        if flag == "BAD":
            bad.append(name)
            diff(r)
    print("BAD:", bad)
