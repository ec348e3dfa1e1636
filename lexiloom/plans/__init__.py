"""Queries over the driver's tables."""

from lexiloom.plans import queries, service  # noqa: F401  they enter their queries
from lexiloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
