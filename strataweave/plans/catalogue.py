"""All core queries by name, with their SQL counterparts."""

from __future__ import annotations

from strataweave.plans import interval_queries, memory_queries, search_queries, store_queries, stream_queries, text_queries, write_queries

MODULES = [interval_queries, store_queries, text_queries, write_queries, search_queries, memory_queries, stream_queries]
FLAGSHIP = "recalled"


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
