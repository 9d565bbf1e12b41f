"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from . import counter_queries, graph_queries, link_queries, recall_queries, telemetry_queries, text_queries

FLAGSHIP = "graph_node_filter"
_ALL = (graph_queries, link_queries, telemetry_queries, counter_queries, text_queries, recall_queries)


def queries():
    return {name: run for m in _ALL for name, (run, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _ALL for name, (_, sql) in m.QUERIES.items() if sql}
