"""Comparison of a Spark result with a DuckDB one."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str([cell(x) for x in v])
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(spark_df, sql: str) -> None:
    got, want = spark_df.toPandas(), duck().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
