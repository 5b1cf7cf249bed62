"""Comparison of a query with its SQL, without regard to order."""

import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(columns)
    return order, sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rows)


def duck(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def same(df, sql, con):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.sql(sql)
    want = rows_of(r.columns, r.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
