"""Registered queries against their SQL on the smallest tables, and which queries there are."""

import pytest

from extentlake.llm import registry

from ..oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
