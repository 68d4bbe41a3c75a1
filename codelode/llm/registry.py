"""All queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from codelode.llm import credential_queries, docpair_queries, handwritten_queries, leak_queries, neighbour_queries, subject_queries, syntax_queries, token_queries

MODULES = [credential_queries, docpair_queries, handwritten_queries, leak_queries, neighbour_queries, subject_queries, syntax_queries, token_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
