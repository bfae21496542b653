"""Rows of Spark and of DuckDB in one comparable form."""

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def text(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "None"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if v != v:
            return "None"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([text(x) for x in v])
    return str(v)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(text, r)) for r in frame.astype(object).itertuples(index=False))
