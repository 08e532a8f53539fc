"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from tessera.plans import flow_queries, graph_queries, registry, retrieval_queries, routing_queries, search_queries, source_queries  # noqa: F401

FLAGSHIP = "q01_topk_cosine"
QUERIES = registry.QUERIES
SQL = registry.SQL
