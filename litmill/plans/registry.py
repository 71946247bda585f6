"""All queries of the core, with the SQL that says the same where there is one."""

from __future__ import annotations

from litmill.plans import catalog, core_queries, dedupe_queries, graph_queries, library_queries, maintenance_queries, pattern_queries, retrieval_queries, text_queries, work_queries  # noqa: F401 - they register their queries


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
