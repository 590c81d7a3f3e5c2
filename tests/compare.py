"""Rows of a query and of its SQL as comparable multisets."""

import math
import os
from collections import Counter
from decimal import Decimal


def value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def check(spark, con, folder, query, sql):
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert mine == theirs, f"only here: {list((mine - theirs).items())[:3]}, only in SQL: {list((theirs - mine).items())[:3]}"
