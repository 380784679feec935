"""Rows of Spark and of the SQL oracle, made comparable."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v if isinstance(v, (int, bool)) else str(v)


def oracle(sf_dir):
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())


def rows_of_sql(c, sql):
    r = c.sql(sql)
    names = r.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(norm(x[i]) for i in order)) for x in r.fetchall())
