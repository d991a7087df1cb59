"""Registered queries: one for each operator, over the tables at hand, with SQL where it can say the same."""

from gridloom.queries import analysis, features, ingest, models, monitoring
from gridloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "features", "ingest", "models", "monitoring"]
