"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def views(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in os.listdir(d):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{d}/{t}'")
    return c


def text(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(text(x) for x in v) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{v + 0.0:.6g}"
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted("|".join(text(v) for v in r) for r in df[cols].itertuples(index=False))


def same(spark, query, sql: str, d: str = SMALL) -> None:
    got, want = query(spark, d).toPandas(), views(d).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
