"""A query's rows beside those of its DuckDB SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return list(v) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


def assert_same(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert got == want
