"""Rows of a Spark query against rows of its SQL."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else v) for v in row)


def database(folder):
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return db


def both(df, db, sql):
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    got = db.sql(sql)
    assert sorted(got.columns) == names
    at = [got.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=key)
    return ours, theirs
