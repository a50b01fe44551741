"""The grids of catalog items are read once for each row."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["p24_projection_pick", "p19_source_grid"])
def test_values_are_read_once(spark, sf_dir, name):
    """Three reads a key (its kind, the asset's own value, the item's), of six keys at most."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("proj:transform']") <= 18
