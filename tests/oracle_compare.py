"""Run a registered query in Spark and its SQL twin in DuckDB, compare.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from hyrank.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, key: str, sf_dir: str, con=None) -> tuple[bool, str]:
    con = con or duck(sf_dir)
    t0 = time.time()
    s = E.queries()[key](spark, sf_dir).toPandas()
    t1 = time.time()
    sql = E.oracle_sql().get(key)
    if sql is None:         # those of the optional folder, and the k-means index, may lack a twin; they have tests of their own
        return key.startswith("op") or key in ("pipeline", "ivf_recall"), f"{key}: spark rows={len(s)} ({t1 - t0:.1f}s), no oracle"
    o = con.sql(sql).df()
    t2 = time.time()
    if sorted(s.columns) != sorted(o.columns):
        return False, f"{key}: columns differ spark={sorted(s.columns)} oracle={sorted(o.columns)}"
    a, b = normalise(s), normalise(o)
    if len(a) != len(b):
        return False, f"{key}: rows spark={len(a)} oracle={len(b)}"
    eq = True
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_numeric_dtype(x) and pd.api.types.is_numeric_dtype(y):
            ok = ((x.astype(float) - y.astype(float)).abs() <= 1e-9) | (x.isna() & y.isna())
        else:
            ok = (x.astype(str) == y.astype(str))
        if not ok.all():
            eq = False
            bad = (~ok).to_numpy().nonzero()[0][:3]
            return False, f"{key}: column {c} differs at {bad}: spark={list(x.iloc[bad])} oracle={list(y.iloc[bad])}"
    return eq, f"{key}: OK rows={len(a)} spark {t1 - t0:.1f}s oracle {t2 - t1:.1f}s"


if __name__ == "__main__":
    from hyrank.session import get_spark
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(E.queries())
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            ok, msg = compare(spark, k, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{k}: ERROR {type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} passed")
