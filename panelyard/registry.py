"""Name -> query and name -> DuckDB SQL of the library's own operators."""

from __future__ import annotations

from panelyard.plans import feature_queries, metric_queries, model_queries, panel_queries, triage_queries

_ALL = [*panel_queries.QUERIES, *feature_queries.QUERIES, *metric_queries.QUERIES, *model_queries.QUERIES, *triage_queries.QUERIES]
QUERIES = {q.name: q.run for q in _ALL}
ORACLES = {q.name: q.sql for q in _ALL if q.sql is not None}
