"""Run registered queries in Spark and their SQL in DuckDB, and compare.

Comparison: same column names (sorted), same row count, same multiset of
rows (values compared exactly; NaN equals NaN).  Usable from pytest and as a
script: ``python tests/oracle_check.py /root/testdata/sf0.01 [names...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(type(v).__name__), str(v)) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=_key)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    s_cols, s_sorted = rows_of(sdf.columns, s_rows)
    res = {"name": name, "rows_spark": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    d_cols, d_sorted = rows_of(d_cols, d_rows)
    res["rows_duck"] = len(d_rows)
    if s_cols != d_cols:
        res["status"] = f"COLUMNS {s_cols} != {d_cols}"
    elif len(s_rows) != len(d_rows):
        res["status"] = "ROWCOUNT"
    elif s_sorted != d_sorted:
        diffs = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:3]
        res["status"] = f"VALUES {diffs}"
    else:
        res["status"] = "ok"
    return res


def main(argv):
    from covercost.session import local_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(E.queries())
    spark = local_session()
    con = duck(sf_dir)
    sql = E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, sf_dir, n, E.queries()[n], sql.get(n), con)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": f"ERROR {type(ex).__name__}: {str(ex)[:400]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
