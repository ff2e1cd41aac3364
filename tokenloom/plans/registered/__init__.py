"""The registered queries, each beside the SQL it is checked with."""

from tokenloom.plans.registered import batching, documents, files, layout, logs  # noqa: F401
from tokenloom.plans.registered.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
