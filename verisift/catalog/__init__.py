"""Runnable queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from .base import Query


def all_queries() -> list[Query]:
    from . import audit_queries, corpus_queries, metric_queries, model_queries, sentiment_queries
    from . import source_queries, text_queries, verdict_queries

    modules = (
        source_queries,
        text_queries,
        sentiment_queries,
        corpus_queries,
        metric_queries,
        audit_queries,
        verdict_queries,
        model_queries,
    )
    return [query for module in modules for query in module.QUERIES]
