"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb
import pandas as pd


def connect(d):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    return c


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or type(v).__name__.startswith("float"):
        return repr(round(float(v), 6) + 0.0)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))
