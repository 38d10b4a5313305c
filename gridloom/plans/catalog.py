"""All queries over the library's own operators."""

from gridloom.plans import queries_arrays, queries_edit, queries_more, queries_sets  # noqa: F401  they register their queries
from gridloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
