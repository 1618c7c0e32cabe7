"""A query beside its SQL: rows without order, numbers to six places."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return int(v) if hasattr(v, "__index__") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    r = con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(r.columns, r.fetchall())
