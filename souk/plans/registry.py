"""Every query of the library by name, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from souk.plans.base import ORACLES, QUERIES
from souk.plans import catalogue, insights, records, rules, snapshots, sources  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
