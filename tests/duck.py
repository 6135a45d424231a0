"""Runs SQL in DuckDB over a data folder and brings both sides' rows to one form."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, float | np.floating):
        return repr(round(float(value), 6))
    if hasattr(value, "isoformat"):
        return str(value).removesuffix(" 00:00:00")
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    if isinstance(value, int | np.integer):
        return str(int(value))
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in found), key=repr)


def same(frame, con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, result.fetchall())
