"""All registered queries."""

from sievegrid.plans import answers, frames  # noqa: F401  they register themselves
from sievegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
