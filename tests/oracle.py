"""Holds a query's rows against those of SQL on the same files."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return columns, sorted([tuple(map(plain, r)) for r in frame.where(frame.notna(), None).values.tolist()], key=str)


def assert_same(spark, query, sql, sf_dir=SMALL):
    assert rows(query(spark, sf_dir).toPandas()) == rows(connect(sf_dir).sql(sql).df())
