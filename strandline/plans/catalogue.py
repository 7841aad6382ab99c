"""All queries of the library outside of the corpus operators."""

from __future__ import annotations

from . import analytics, evaluation, modelling  # noqa: F401  they register their queries
from .relational import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
