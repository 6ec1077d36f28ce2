"""All registered queries."""

from affinity.plans import basics, learn, recs  # noqa: F401
from affinity.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
