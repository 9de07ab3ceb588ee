"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidencelake.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(FOLDER).glob("*.parquet")]
#: Operators of the library that no SQL can express; their rows are tested elsewhere.
ROWS_ONLY = {"coverage", "coverage_best", "error_rates", "human_edit", "paraphrase", "transform_grid"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(int(v)) if type(v).__name__.startswith(("int", "uint")) else str(v)


def rows(frame, columns):
    return sorted(tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), oracle.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_all_queries_have_sql_or_are_listed():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
