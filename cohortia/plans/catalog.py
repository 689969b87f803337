"""Collects the queries of all catalog modules."""

from cohortia.plans import learn_catalog, marker_catalog, ml_catalog, stats_catalog, summaries_catalog, verbs_catalog  # noqa: F401
from cohortia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
