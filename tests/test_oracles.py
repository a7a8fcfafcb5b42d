"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from munim.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("MUNIM_SF_DIR", "/root/testdata/sf0.001")



@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name)) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"isolation_forest"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
