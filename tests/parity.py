"""Rows of a query and of its SQL, in one form."""

import datetime as dt
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, con, query, sql, data):
    df = query(spark, data)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    return mine, sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
