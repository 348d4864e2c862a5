"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from impactlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert got["ok"] is not False, got


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["node", "depth", "sites", "proved"] and df.count() > 0
