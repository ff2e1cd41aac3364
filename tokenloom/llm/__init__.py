"""Operators for training-data pipelines.  Nothing else in the library imports this subpackage.

``QUERIES`` and ``CHECKS`` hold the queries of the operators and the SQL of those that SQL can express.
"""

from tokenloom.llm import queries  # noqa: F401
from tokenloom.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
