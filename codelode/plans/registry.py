"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from codelode.plans import capsule_queries, event_queries, extract_queries, graph_queries, maintain_queries, note_queries, orphan_queries, rank_queries, text_queries

MODULES = [orphan_queries, graph_queries, text_queries, maintain_queries, event_queries, rank_queries, extract_queries, note_queries, capsule_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
