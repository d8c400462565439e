"""Every query of the core: name -> callable, and the SQL that must give the same."""

from __future__ import annotations

from glossweave.plans import dictionary_queries, format_queries, scoring_queries, span_queries, stream_queries

QUERIES = dict(dictionary_queries.QUERIES) | span_queries.QUERIES | scoring_queries.QUERIES | stream_queries.QUERIES | format_queries.QUERIES
SQL = dict(dictionary_queries.SQL) | span_queries.SQL | scoring_queries.SQL | stream_queries.SQL | format_queries.SQL
