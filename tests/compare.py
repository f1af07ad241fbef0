"""Rows of a query against rows of its SQL twin."""

import decimal
import glob
import math
import os

import duckdb


def database(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view \"{os.path.basename(p)[:-8]}\" as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(dicts, columns):
    return sorted((tuple(plain(d[c]) for c in columns) for d in dicts), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    mine = rows([r.asDict() for r in df.collect()], columns)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert mine == rows([dict(zip(names, r)) for r in rel.fetchall()], columns)
