"""The engine by name: each tool takes frames or plain values and returns a frame, so that a server or a notebook can dispatch to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import curate, epistemic, evaluate, graph, memory, relational, resolve, retrieve, services
from .streaming import sync

TOOLS: dict[str, Callable] = {
    "search": retrieve.search, "get_node": relational.by_ids, "provenance": relational.provenance, "traverse": graph.bfs, "shortest_path": graph.shortest_path, "resolve": resolve.tiered,
    "communities": graph.communities, "contradictions": relational.contentions, "memory_recall": memory.recalled, "memory_forget": memory.forgotten, "memory_consolidate": memory.consolidated,
    "blast_radius": graph.blast_radius, "health": relational.health, "graph_stats": relational.stats, "deep_consolidation": curate.consolidated, "epistemic_closure": epistemic.closure,
    "correct_edges": services.edges_corrected, "delete_edges": services.edges_deleted, "reprocess": services.reprocessed, "changes": sync.after, "expand_query": retrieve.textually_expanded,
}


def call(name: str, *args, **kwargs):
    if name not in TOOLS:
        raise KeyError(f"no tool {name}; there are {', '.join(TOOLS)}")
    return TOOLS[name](*args, **kwargs)


def evaluated(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """metric, value over all queries of golden data (query, id, grade) and ranked results (query, id, rank): the evaluation run."""
    one = evaluate.metrics(results, golden, k)
    names = [c for c in one.columns if c != "query"]
    mean = one.agg(*(F.avg(c).alias(c) for c in names))
    return mean.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))))
