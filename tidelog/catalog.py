"""Names of the queries: each with its DataFrame form and, where SQL can express it, its SQL."""

from __future__ import annotations

from tidelog.plans import log_queries, other_queries, service_queries  # noqa: F401 (service_queries registers with other_queries)


def queries() -> dict:
    return log_queries.QUERIES | other_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return log_queries.SQL | other_queries.SQL
