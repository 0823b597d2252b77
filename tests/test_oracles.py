"""Every registered grid query against its DuckDB oracle, where the test data is there."""

import os

import pytest

from gridloom.plans.oracles import ORACLES
from gridloom.plans.queries import QUERIES
from verify import compare, oracle_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert compare((df.columns, [tuple(r) for r in df.collect()]), oracle_rows(ORACLES[name], SF_DIR)) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_queries_without_oracle_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
