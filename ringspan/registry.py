"""Queries and SQL of the library's own operators."""

from __future__ import annotations

from .plans import evaluation_queries, graph_queries, pair_queries, service_queries, stream_queries, window_queries

_MODULES = (window_queries, pair_queries, graph_queries, evaluation_queries, stream_queries, service_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return QUERIES["W1_band_counts"](spark, sf_dir)
