"""Row-by-row comparison of a Spark result with DuckDB's."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def duck(folder: str = SMALL):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else str(x))
    keys = df.round(6)
    return df.loc[keys.sort_values(list(keys.columns), na_position="first", kind="stable").index].reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """'' or what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)} expected"
    a, b = ordered(a), ordered(b)
    for c in a.columns:
        x, y = a[c], b[c]
        try:
            ok = np.isclose(pd.to_numeric(x).astype(float), pd.to_numeric(y).astype(float), rtol=1e-7, atol=2e-6, equal_nan=True)
        except (ValueError, TypeError):
            ok = ((x == y) | (x.isna() & y.isna())).to_numpy()
        if not ok.all():
            k = np.flatnonzero(~ok)
            return f"{c}: {len(k)} rows differ, first {x[k[0]]!r} and {y[k[0]]!r}"
    return ""
