"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import pytest

import checks

from .compare import compare, connect
from .conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, con, name):
    difference, _, _ = compare(spark, con, checks.QUERIES[name], checks.ORACLES.get(name), SF)
    assert difference is None


def test_oracles_have_queries():
    assert set(checks.ORACLES) <= set(checks.QUERIES)


def test_partitioning_does_not_change_results(spark, spread, con):
    for name in ("pareto_tiers", "streaks_hot_entity", "efficiency_frontier", "merge_warnings", "relationships_exact", "join_outer_hot_key"):
        difference, _, _ = compare(spark, con, checks.QUERIES[name], checks.ORACLES[name], SF)
        assert difference is None, name
