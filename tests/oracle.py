"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(x):
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    return float(f"{x:.9g}") if isinstance(x, float) else x


def canonical(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            most = abs(df[c]).max()  # missing where every value is
            df = df.assign(**{c: df[c].astype("float64") if pd.isna(most) or most < 2**53 else df[c].astype(str)})
    return list(df.columns), sorted((tuple(map(_cell, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)
