"""A command line over a stored graph and the scorer.

    python -m graphloom.cli GRAPH_PATH VERB [ARGUMENT ...]

Verbs are those of ``VERBS``; without one, lines are read from standard input.
"""

from __future__ import annotations

import json
import shlex
import sys

from graphloom.operators.agent import rows_of
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.scoring import COMPONENTS

VERBS = {
    "schema": (0, "labels, relationships and their counts"), "concepts": (0, "all concepts"), "links": (1, "CONCEPT [DATABASE]: what a concept is linked to"), "node": (1, "NAME: a node's neighbours"), "tables": (0, "[DATABASE]: tables"),
    "cross": (0, "edges between databases"), "search": (1, "WORD: nodes by substring"), "subgraph": (1, "NAME [DEPTH]: what is near"), "path": (2, "FROM TO: a shortest path"), "columns": (1, "WORD: who has such a column"),
    "shared": (0, "concepts of several databases"), "summary": (1, "DATABASE: tables and concepts"), "trace": (2, "NAME DATABASE: ways into a database"), "sql": (1, "QUERY on vertices and edges"),
}


def run(graph: PropertyGraph, verb: str, args: list[str]) -> list[dict] | str:
    """A verb's rows, or a text that says what is wrong."""
    if verb not in VERBS:
        return "\n".join(f"{v}: {what}" for v, (_, what) in VERBS.items())
    if len(args) < VERBS[verb][0]:
        return f"{verb}: {VERBS[verb][1]}"
    g = graph
    calls = {
        "schema": g.schema, "concepts": g.list_concepts, "links": g.concept_links, "node": g.node_details, "tables": g.list_tables, "cross": g.cross_db_edges, "search": g.search, "columns": g.find_columns, "shared": g.shared_concepts, "summary": g.database_summary, "trace": g.trace_cross_db,
        "subgraph": lambda name, depth="2": g.subgraph(name, int(depth)), "path": g.path_between, "sql": lambda *words: g.query(g.vertices.sparkSession, " ".join(words)),
    }
    return rows_of(calls[verb](*args))


def render_score(row: dict) -> str:
    """A scored employee as text: the total, and a line for each component."""
    head = f"{row.get('name')} ({row.get('iga')}): {row['total_score']:.2f} of 100, {row['components_calculated']} components, {row['missing_data']} missing"
    lines = [f"  {c.replace('_', ' '):16} " + ("no data" if row.get(f"{c}_score") is None else f"{row[f'{c}_score']:6.1f} -> {row[f'{c}_weighted']:5.2f}") for c in COMPONENTS]
    return "\n".join([head, *lines])


def main(argv: list[str]) -> int:
    from graphloom.session import session
    from graphloom.sources.store import GraphStore

    if not argv:
        print(__doc__)
        return 2
    graph = GraphStore(session("cli"), argv[0]).load()
    lines = [argv[1:]] if argv[1:] else (shlex.split(x) for x in sys.stdin)
    for words in lines:
        if words:
            out = run(graph, words[0], words[1:])
            print(out if isinstance(out, str) else json.dumps(out, default=str, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
