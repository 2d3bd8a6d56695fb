"""Every query of the library against its DuckDB twin."""

from __future__ import annotations

import pytest

from souk.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
