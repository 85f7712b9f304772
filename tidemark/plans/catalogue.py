"""All queries of the core, by name, with their oracle SQL."""

from __future__ import annotations

from tidemark.plans import demand_queries, ladders, model_queries, pair_queries, rec_queries, scale_queries, source_queries, txn_queries

_PARTS = (txn_queries, demand_queries, rec_queries, pair_queries, model_queries, ladders, scale_queries, source_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
FLAGSHIP = "min_cost_threshold"
