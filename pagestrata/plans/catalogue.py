"""Every registered query of the core, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagestrata.plans import audit_queries, audit_sql, derived_queries, html_queries, link_queries

FLAGSHIP = "health_score"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**audit_queries.QUERIES, **link_queries.QUERIES, **derived_queries.QUERIES, **html_queries.QUERIES}
ORACLE: dict[str, str] = {**audit_sql.ORACLE, **link_queries.ORACLE, **derived_queries.ORACLE, **html_queries.ORACLE}
