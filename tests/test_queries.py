import os

import pytest

import __spark_entry__ as entry
from lexforge.plans import queries
from tests.compare import from_spark, from_sql

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert from_spark(queries.QUERIES[name](spark, DATA)) == from_sql(queries.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
