from __future__ import annotations

import pytest

from mnemoflow.llm import catalog
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    check(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
