"""All registered queries."""

from __future__ import annotations

from apiquarry.plans import q_flows, q_inventory, q_paths, q_sources, q_traffic  # noqa: F401
from apiquarry.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
