"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import more_queries  # noqa: F401 - registers its own
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
