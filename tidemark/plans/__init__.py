"""All registered queries."""

from tidemark.plans import cleaning, drifts, features, metrics, models, splitting, streams  # noqa: F401
from tidemark.plans.registry import QUERIES

__all__ = ["QUERIES"]
