"""Registered queries, by name, and their SQL."""

from . import catalog, formats, graphs, models, reconstruction, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog", "formats", "graphs", "models", "reconstruction", "tables"]
