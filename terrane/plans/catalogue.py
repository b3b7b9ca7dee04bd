"""All queries of the tabular operators by name, with the SQL that DuckDB must agree with."""

from __future__ import annotations

from terrane.plans import models, parsing, statistics, study
from terrane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "models", "parsing", "statistics", "study"]
