"""All queries on the driver's tables and their SQL twins."""

from __future__ import annotations

from .plans import clones, details, extended, graphs, lookups, reporting, similar, texts
from .plans.clones import exact_classes

_MODULES = (texts, clones, graphs, similar, lookups, reporting, details, extended)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "exact_classes"]
