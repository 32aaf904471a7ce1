"""Every registered query against its DuckDB statement on the smallest test data."""

import pytest

import __spark_entry__ as entry_module
from tools.check import compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    message, _, good = compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert good, message


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["pair_id", "prompt", "chosen", "rejected", "ang"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
