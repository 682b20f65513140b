"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from workload import book_queries, call_queries, detail_queries, normalize_queries, prompt_queries, screen_queries, source_queries, storage_queries, text_queries

GROUPS = (screen_queries, normalize_queries, source_queries, storage_queries, book_queries, text_queries, call_queries, detail_queries, prompt_queries)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for group in GROUPS:
    QUERIES.update(group.Q)
    ORACLES.update(group.SQL)
