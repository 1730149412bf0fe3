"""Every registered query at the smallest scale, next to its SQL in DuckDB."""

import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SLOW_WITHOUT_SQL = {"m4_classifier", "m5_regressor"}  # covered by test_models
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in queries() if n not in SLOW_WITHOUT_SQL])
def test_query(spark, con, name):
    verdict = compare(spark, con, SF_DIR, name, queries()[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_every_check_has_its_query():
    assert set(SQL) <= set(queries())
