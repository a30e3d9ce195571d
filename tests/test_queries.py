"""Every query with SQL gives on the smallest tables what DuckDB gives."""

import math
import os

import duckdb
import pytest

from basketry.plans import catalogue
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = oracle.execute(SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    want = sorted(repr([plain(r[at.index(c)]) for c in columns]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
