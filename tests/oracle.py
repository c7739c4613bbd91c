"""Rows of a Spark query against DuckDB on the same tables, in any order."""

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def assert_same(df, sql, sf_dir):
    names, want = duck_rows(sql, sf_dir)
    got = df.collect()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = Counter(tuple(norm(r[c]) for c in order) for r in got)
    b = Counter(tuple(norm(r[names.index(c)]) for c in order) for r in want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
