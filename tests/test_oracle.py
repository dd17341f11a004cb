"""Every registered query with SQL gives DuckDB's rows; the others run."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import differences, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    if name in SQL:
        assert differences(spark, con, QUERIES[name], SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
