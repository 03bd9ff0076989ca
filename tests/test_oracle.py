"""Every registered query against its DuckDB twin on the smallest tables (the driver's gate, run locally)."""

import os

import pytest

from tests.conftest import SMALL

pytest.importorskip("duckdb")

from tools.check_oracle import compare, duck  # noqa: E402
from trajectra.plans import load_all  # noqa: E402

QUERIES = load_all()
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SMALL):
        pytest.skip("test tables not present")
    return duck(SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql_twin(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SMALL)
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
