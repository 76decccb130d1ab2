"""API-estate analytics on Spark: endpoint inventories, traffic, templates and test flows
of many projects at once, as DataFrame in / DataFrame out functions."""

from apiquarry.session import build_session, cut_lineage

__all__ = ["build_session", "cut_lineage"]
