"""All registered queries by name."""

from __future__ import annotations

from spendlake.plans import calendar_queries, file_queries, source_queries, spend_queries, stream_queries

QUERIES = {
    **spend_queries.QUERIES, **calendar_queries.QUERIES, **source_queries.QUERIES, **file_queries.QUERIES,
    **stream_queries.QUERIES,
}
