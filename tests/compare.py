"""Runs a query and its SQL side by side: the same columns, and the same rows in any order."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, run, sql):
    """Columns of both sides, and a few rows that only one side has."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = rows_of(columns, cur.fetchall())
    return sorted(df.columns), sorted(columns), list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
