"""All queries over the stored tables, and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from tidemark.catalog.base import ORACLE_SQL, QUERIES

for _name in ("scans", "features", "sessions", "strategies", "aggregates", "joins", "consolidation", "trips", "selection", "jobs", "extras", "closeness"):
    import_module(f"tidemark.catalog.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
