"""Rows of a query against those of DuckDB's SQL, whatever their order."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(df, con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    mine = sorted(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect())
    theirs = sorted(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in r.fetchall())
    assert mine == theirs
