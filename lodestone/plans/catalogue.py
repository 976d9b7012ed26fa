"""Every registered query of the engine and its SQL twin."""

from __future__ import annotations

from lodestone.plans import graph_queries, retrieval_queries, text_queries

_PARTS = (text_queries, retrieval_queries, graph_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
