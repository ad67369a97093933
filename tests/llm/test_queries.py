"""Registered queries: one for each operator, equal to their SQL where there is one."""

from __future__ import annotations

import re

import pytest

import __spark_entry__
from tablescope.llm import queries

from ..compare import compare, connect
from ..conftest import SF


def test_each_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    difference, _, _ = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES.get(name), SF)
    assert difference is None
