"""Every query of the memory engine against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from anamnesis import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6).map(lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6f}")
        else:
            df[c] = df[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else "null" if v is None or v is pd.NaT or v is pd.NA else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, small, con):
    got, want = plain(QUERIES[name](spark, small).toPandas()), plain(con.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert catalog.flagship(spark, small).count() > 0
