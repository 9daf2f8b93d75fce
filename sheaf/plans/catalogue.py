"""Named queries over the standard tables, and the SQL that checks each."""

from __future__ import annotations

from . import integrity, lists, retrieval, text  # noqa: F401  they register their queries
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
