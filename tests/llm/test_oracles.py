"""Queries that have SQL give the same rows in DuckDB."""

import os

import duckdb
import pytest

from anamnesis.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    clean = lambda v: None if v is None else round(v, 6) if isinstance(v, float) else v
    got = QUERIES[name](spark, small)
    names = sorted(got.columns)
    mine = sorted((tuple(clean(r[c]) for c in names) for r in got.collect()), key=str)
    cursor = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})")
    theirs = sorted((tuple(clean(v) for v in r) for r in cursor.fetchall()), key=str)
    assert len(mine) == len(theirs) and [list(map(str, r)) for r in mine] == [list(map(str, r)) for r in theirs]
