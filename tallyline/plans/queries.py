"""All registered queries of the library."""

from tallyline.plans import catalog, ordered, records  # noqa: F401
from tallyline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
