"""Queries next to their SQL on the smallest tables."""

import pytest

from foldwise.llm import queries
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, tiny, name):
    verdict, _ = compare(spark, tiny, connect(tiny), name, queries.QUERIES[name], queries.SQL[name])
    assert verdict.startswith("ok"), verdict


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
