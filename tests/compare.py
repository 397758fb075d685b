"""Holds a query against its SQL in DuckDB, as unordered rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or (not isinstance(x, list | dict) and not hasattr(x, "tolist") and pd.isna(x)):
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.6g}" if isinstance(x, int | float) else str(x)

    names = sorted(df.columns)
    return sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False)), key=str)
