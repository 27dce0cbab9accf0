"""Every registered query with its SQL counterpart (None where SQL cannot express it)."""

from __future__ import annotations

from contract import plan_queries, source_queries, stats_queries

ALL = {**plan_queries.QUERIES, **source_queries.QUERIES, **stats_queries.QUERIES}
