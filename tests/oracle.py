"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9) + 0.0
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and len(a):
            out.append(f"{c}: type {a[c].dtype} != {b[c].dtype}")
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            out.append(f"{c}: {int(bad.sum())} values differ, e.g. {a[c][bad].iloc[0]!r} != {b[c][bad].iloc[0]!r}")
    return out
