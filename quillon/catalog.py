"""All queries of the engine by name, and the SQL that each one equals."""

from quillon.plans import contact_queries  # noqa: F401  registers its queries
from quillon.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
