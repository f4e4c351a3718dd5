"""Tools, their router, and the loops that call them; planners are given from outside."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from graphloom.operators import joinkeys, scoring
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.hints import graph_hints
from graphloom.operators.sqlguard import Databases, Tracker

RESULT_CHARS = 8000
MOST_ROWS = 1000
# fixed values: step limits of the planners
MAX_STEPS, STANDARD_STEPS, DISCOVER_STEPS, EXPLORE_STEPS, WORKERS = 35, 20, 8, 10, 4
Planner = Callable[[list[dict]], dict]


class Rows(list):
    """A tool's rows, and whether there are more of them than are given."""

    truncated = False


def rows_of(result: Any) -> Any:
    """A tool's result as plain data, of each table ``MOST_ROWS`` rows at most."""
    if isinstance(result, DataFrame):
        rows = Rows(r.asDict(recursive=True) for r in result.limit(MOST_ROWS + 1).collect())
        rows.truncated = len(rows) > MOST_ROWS
        del rows[MOST_ROWS:]
        return rows
    if isinstance(result, tuple):
        parts = [rows_of(part) for part in result]
        rows = Rows(x for part in parts for x in part)
        rows.truncated = any(getattr(part, "truncated", False) for part in parts)
        return rows
    return result


def told(result: Any) -> str:
    """A result as a planner reads it; one that was cut says so."""
    if getattr(result, "truncated", False):
        result = {"truncated": True, "rows_given": len(result), "rows": result}
    return cut(json.dumps(result, default=str))


def cut(text: str, most: int = RESULT_CHARS) -> str:
    return text if len(text) <= most else text[:most] + "... [truncated]"


WHAT = {
    "schema": "labels and relationship types with their counts",
    "list_concepts": "all concepts with their databases and source tables",
    "concept_links": "tables and concepts that a concept is linked to",
    "node_details": "a node with all its neighbours",
    "list_tables": "tables, of one database or of all",
    "cross_db_edges": "edges between two databases",
    "search": "nodes whose name or description has the keyword",
    "subgraph": "nodes and edges within some steps of a node",
    "path_between": "a shortest path between two nodes",
    "find_columns": "nodes with a column of that name",
    "shared_concepts": "concepts of more than one database",
    "database_summary": "a database's tables and concepts",
    "trace_cross_db": "ways from a node into another database",
    "semantic_concept_search": "concepts by keywords, the best first",
    "find_join_keys": "columns that tables can be joined on; ask before a query with joins",
    "execute_query": "rows of a read-only query on one database",
    "get_sample_data": "some rows of a table",
    "calculate_employee_score": "the weighted score of one employee, by name or iga",
    "find_top_performing_crew": "employees by score, filtered",
}
_JSON = {"int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object"}


def _json_type(p: inspect.Parameter) -> dict:
    """A parameter's JSON type by its annotation, or else by its default; text if neither says."""
    kind = p.annotation if p.annotation is not inspect.Parameter.empty else type(p.default).__name__
    kind = re.split(r"[\[ |]", str(getattr(kind, "__name__", kind)))[0]
    out: dict = {"type": _JSON.get(kind, "string")}
    return out | ({"items": {"type": "string"}} if out["type"] == "array" else {})


@dataclass
class Tools:
    """The tools by name.  ``sources`` are hr, perf, leave and nps for scoring, ``databases`` for SQL; without those their tools are missing."""

    graph: PropertyGraph
    databases: Databases | None = None
    sources: dict[str, DataFrame] | None = None
    parameters: dict | None = None
    tracker: Tracker = field(default_factory=Tracker)

    def registry(self) -> dict[str, Callable[..., Any]]:
        g = self.graph
        out: dict[str, Callable[..., Any]] = {
            "schema": g.schema, "list_concepts": g.list_concepts, "concept_links": g.concept_links, "node_details": g.node_details, "list_tables": g.list_tables, "cross_db_edges": g.cross_db_edges, "search": g.search,
            "subgraph": g.subgraph, "path_between": lambda start, end, max_depth=10: g.path_between(start, end, max_depth), "find_columns": g.find_columns, "shared_concepts": g.shared_concepts, "database_summary": g.database_summary, "trace_cross_db": g.trace_cross_db,
            "semantic_concept_search": lambda keywords, purpose="": joinkeys.semantic_search(g, keywords), "find_join_keys": self._join_keys,
        }
        if self.databases:
            out |= {"execute_query": self._execute, "get_sample_data": self.databases.sample}
        if self.sources:
            joined = scoring.join_sources(**self.sources)
            out |= {"calculate_employee_score": lambda identifier, by="name": scoring.score_one(joined, identifier, by, self.parameters), "find_top_performing_crew": lambda **a: scoring.rank(joined, params=self.parameters, **a)}
        return out

    def schemas(self) -> list[dict]:
        """What a planner is told of each tool: its name, what it does, and its parameters as a JSON schema."""
        out = []
        for name, tool in self.registry().items():
            given = {k: p for k, p in inspect.signature(tool).parameters.items() if p.kind is not inspect.Parameter.VAR_KEYWORD}
            if name == "find_top_performing_crew":
                given = {k: p for k, p in inspect.signature(scoring.rank).parameters.items() if k not in ("joined", "params")}
            properties = {k: _json_type(p) for k, p in given.items()}
            needed = [k for k, p in given.items() if p.default is inspect.Parameter.empty]
            out.append({"name": name, "description": WHAT[name], "parameters": {"type": "object", "properties": properties, "required": needed}})
        return out

    def _join_keys(self, tables: list[str]) -> dict:
        self.tracker.keys_asked = True
        found = joinkeys.find_join_keys(self.graph, tables)
        self.tracker.join_column = found.get("best_join_column")
        return found

    def _execute(self, database: str, query: str, limit: int = 100) -> dict:
        return self.tracker.check(self.databases.spark, database, query) or self.databases.execute_query(database, query, limit)

    def dispatch(self, name: str, args: dict) -> Any:
        """A tool's plain result; an unknown tool or a failure is an error result."""
        tool = self.registry().get(name)
        if tool is None:
            return {"error": f"unknown tool {name}"}
        try:
            return rows_of(tool(**args))
        except Exception as e:  # the planner gets every failure as a result
            return {"error": f"{type(e).__name__}: {str(e).splitlines()[0]}"}


def loop(tools: Tools, planner: Planner, question: str, steps: int = MAX_STEPS) -> Iterator[dict]:
    """Events of a run: tool calls with their results and hints, then the answer.

    The planner sees the messages and gives ``{"calls": [(name, args), ...]}``
    or ``{"answer": text}``.  A call made before isn't made again; if the steps
    run out, the planner's last text is the answer.
    """
    messages, seen, last = [{"role": "user", "content": question}], set(), ""
    for _ in range(steps):
        move = planner(messages)
        last = move.get("text") or last
        if "answer" in move or not move.get("calls"):
            yield {"type": "answer", "content": move.get("answer", last)}
            return
        for name, args in move["calls"]:
            key = json.dumps([name, args], sort_keys=True, default=str)
            result = {"note": "this call was made before"} if key in seen else tools.dispatch(name, args)
            seen.add(key)
            cut_off = getattr(result, "truncated", False) or (isinstance(result, dict) and bool(result.get("truncated")))
            yield {"type": "tool", "name": name, "args": args, "result": result, "truncated": cut_off, "graph": graph_hints(name, result if isinstance(result, list) else result.get("join_recommendations", []))}
            messages.append({"role": "tool", "name": name, "content": told(result)})
    yield {"type": "answer", "content": last or "no answer was found"}


def answer(tools: Tools, planner: Planner, question: str, steps: int = STANDARD_STEPS) -> str:
    return [e for e in loop(tools, planner, question, steps)][-1]["content"]


def single_shot(tools: Tools, plan: Callable[[str], list[tuple[str, dict]]], compose: Callable[[str, list], str], question: str) -> str:
    """All calls of one plan, in order, and the text composed of their results."""
    return compose(question, [(name, tools.dispatch(name, args)) for name, args in plan(question)])


def tree(tools: Tools, discover: Planner, explore: Planner, compose: Callable[[str, dict], str], question: str) -> str:
    """Concepts are discovered, each is explored in a thread of its own, and the findings are composed."""
    found = answer(tools, discover, question, DISCOVER_STEPS)
    topics = json.loads(found) if found.startswith("[") else [found]
    with ThreadPoolExecutor(WORKERS) as pool:
        results = list(pool.map(lambda t: answer(Tools(tools.graph, tools.databases, tools.sources, tools.parameters), explore, t, EXPLORE_STEPS), topics))
    return compose(question, dict(zip(topics, results, strict=True)))
