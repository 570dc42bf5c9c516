"""Compares a query with its SQL on DuckDB, order aside."""

import glob
import os

import duckdb


def normal(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return repr(float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def same(df, con, sql):
    out = con.sql(sql)
    assert sorted(df.columns) == sorted(out.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(out.columns, out.fetchall())
