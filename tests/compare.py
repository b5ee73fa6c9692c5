"""Row-by-row comparison of a query with DuckDB, without regard to order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(x):
    if isinstance(x, list | tuple | np.ndarray):
        return tuple(cell(y) for y in x)
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return None
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, int | float | np.integer | np.floating):
        return float(f"{float(x):.9g}")
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(cell(v) for v in r)) for r in frame.itertuples(index=False, name=None))


def same(df, sql, con):
    ours, theirs = df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
