"""Queries and their DuckDB SQL, by name."""

from routeloom.plans import table_queries  # noqa: F401  adds its own
from routeloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
