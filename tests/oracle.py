"""Compares a query's rows with DuckDB's, as bags, columns by name."""

import datetime
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        p = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def assert_same(df, con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    at = [names.index(c) for c in cols]
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    expected = Counter(repr(tuple(plain(r[i]) for i in at)) for r in want)
    assert got == expected, (list((got - expected))[:3], list((expected - got))[:3])
