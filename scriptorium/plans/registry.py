"""The engine's queries and the SQL for them."""

from __future__ import annotations

from . import corpus_fixtures, table_queries, text_queries, token_fixtures  # noqa: F401  all register with the texts' queries

QUERIES = text_queries.QUERIES
ORACLE = text_queries.ORACLE
FLAGSHIP = "anno_tokens"
