"""Run registered queries in Spark and their SQL in DuckDB and compare exactly.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Columns are compared by sorted name; rows as an order-insensitive multiset; doubles
must be equal (no tolerance), as in a value hash.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duck_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in scols) for r in sdf.collect()), key=repr)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted((tuple(_norm(row[i]) for i in order) for row in rel.fetchall()), key=repr)
    problems = []
    if scols != sorted(dcols):
        problems.append(f"columns spark={scols} duck={sorted(dcols)}")
    if len(srows) != len(drows):
        problems.append(f"rows spark={len(srows)} duck={len(drows)}")
    if not problems and srows != drows:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(srows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    from evidence_spark.plans.queries import ORACLE, QUERIES
    from evidence_spark.session import build_session

    spark = build_session("local[8]", 8)
    con = duck_connection(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        if name not in ORACLE:
            n = fn(spark, sf_dir).count()
            print(f"{name:32s} rows-only {n:7d} rows {time.time()-t0:6.1f}s")
            continue
        try:
            problems, n = compare(spark, con, name, fn, ORACLE[name], sf_dir)
        except Exception as e:  # report and continue
            problems, n = [f"error: {type(e).__name__}: {str(e)[:400]}"], -1
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{name:32s} {status} {n:7d} rows {time.time()-t0:6.1f}s {'; '.join(problems)}")
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
