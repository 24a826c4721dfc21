"""All registered queries."""

from fieldtally.plans import basics, intake, series, space, statistics, taxa, watch  # noqa: F401  (importing registers)
from fieldtally.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
