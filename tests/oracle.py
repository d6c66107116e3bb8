"""Runs queries against their SQL twins in DuckDB and compares whole results."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [[_cell(v) for v in frame[n]] for n in names]
    return sorted(zip(*columns), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for name in got.columns:
        a, b = got[name].dtype.kind, want[name].dtype.kind
        if a != b and {a, b} != {"i", "u"}:
            return f"column {name}: {got[name].dtype} != {want[name].dtype}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None
