"""Unifies the concept graphs of a folder.

    python -m graphloom.unifying GRAPHS STORE [--high X] [--low X] [--embedder MODULE:NAME] [--judge MODULE:NAME] [--summary FILE] [--load-only]

GRAPHS has ``*_concept_graph.json`` files.  With ``--load-only`` they are stored
as they are, linked already, and no vectors are compared.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import unify
from graphloom.operators.graph import PropertyGraph
from graphloom.sources.store import GraphStore, edges_in, nodes_in


def named_callable(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def load_only(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and dangling edges of the documents as they are, cleaned and with derived edges."""
    nodes = unify.keep_last(nodes)
    kept, dangling = unify.clean_edges(edges.drop("database"), nodes)
    made = unify.derived_edges(nodes.where("label = 'Concept'"), nodes.where("label = 'Table'"), kept)
    return nodes, kept.unionByName(made, allowMissingColumns=True), dangling


def run(spark: SparkSession, graphs: str, store: str, *, high: float = unify.HIGH, low: float = unify.LOW, embedder: Callable | None = None, judge: Callable | None = None, only_load: bool = False) -> tuple[str, DataFrame]:
    """Stores the unified graph as the whole of ``store``; gives its summary and the dangling edges, which aren't stored."""
    if not 0 <= low <= high:
        raise ValueError(f"thresholds must be 0 <= low <= high, not {low} and {high}")
    nodes, edges = nodes_in(spark, graphs, by_document=not only_load), edges_in(spark, graphs)
    nodes, edges, dangling = load_only(nodes, edges) if only_load else unify.unify_documents(nodes, edges, embedder or unify.letter_vectors, high, low, judge)
    kept = GraphStore(spark, store)
    kept.save(PropertyGraph(nodes, edges), whole=True)
    graph = kept.load()
    return unify.summary_markdown(graph.vertices, graph.edges), dangling


def main(argv: list[str] | None = None) -> int:
    from graphloom.session import session

    p = argparse.ArgumentParser(prog="graphloom.unifying", description="Unify concept graphs")
    p.add_argument("graphs")
    p.add_argument("store")
    p.add_argument("--high", type=float, default=unify.HIGH)
    p.add_argument("--low", type=float, default=unify.LOW)
    p.add_argument("--embedder")
    p.add_argument("--judge")
    p.add_argument("--summary")
    p.add_argument("--load-only", action="store_true")
    a = p.parse_args(argv)
    text, dangling = run(session("unifying"), a.graphs, a.store, high=a.high, low=a.low, embedder=named_callable(a.embedder), judge=named_callable(a.judge), only_load=a.load_only)
    if a.summary:
        with open(a.summary, "w", encoding="utf-8") as f:
            f.write(text)
    print(text)
    print(f"dangling edges: {dangling.count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
