"""Query registry: name -> (Spark callable, equivalent SQL)."""

from __future__ import annotations

from trustgauge.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
