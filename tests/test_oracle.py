"""Every registered query against DuckDB on the smallest data."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, connect
from spanlake.plans.catalog import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
TEXTS = {name: text for name, text in oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, queries()[name], TEXTS.get(name), SF_DIR) == ""


def test_every_query_has_an_oracle():
    assert set(TEXTS) == set(REGISTRY) <= set(queries())


def test_oracle_types_are_plain(con):
    """No wide integers or decimals: their values would not compare with Spark's."""
    for name, text in TEXTS.items():
        types = {str(c[1]) for c in con.execute(text).description}
        assert types <= {"BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "BOOLEAN", "NUMBER", "STRING", "bool"}, (name, types)


def test_entry(spark):
    assert entry(spark).count() > 0
