from __future__ import annotations

import pytest

from mnemoflow import queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    check(spark, sf, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run_alike_twice(spark, sf, name):
    once, again = (sorted(map(str, queries.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert once == again


def test_entry_has_a_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
