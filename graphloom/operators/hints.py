"""Results as small graphs for display: nodes and edges without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import display_name

SCORED_TABLES = (("hr_master", "hr"), ("perf_scores", "performance"), ("leave_raw", "leave"), ("nps_survey", "survey"))
POLICY = ("Weighted Performance Scoring Policy", "Policy")


class _Collector:
    def __init__(self) -> None:
        self.nodes: dict[tuple, dict] = {}
        self.edges: dict[tuple, dict] = {}

    def node(self, name, kind, database="") -> None:
        if name:
            self.nodes.setdefault((name, database or ""), {"name": name, "type": kind, "database": database or ""})

    def edge(self, a, b, label="", a_db="", b_db="") -> None:
        if a and b:
            self.edges.setdefault((a, a_db or "", b, b_db or ""), {"source": a, "target": b, "label": label or "", "source_db": a_db or "", "target_db": b_db or ""})


def graph_hints(tool: str, rows: list[dict]) -> dict:
    """Nodes and edges that a tool's rows show; a tool that shows none gives empty lists.

    ``rows`` have the columns that the tool's query returns.
    """
    c = _Collector()
    get = lambda r, *names: next((r[n] for n in names if r.get(n)), "")
    kind = lambda r, *names: get(r, *names) if get(r, *names) in ("Concept", "Policy") else "Table"
    if tool in ("calculate_employee_score", "find_top_performing_crew"):
        c.node(*POLICY[:1], "Policy", POLICY[1])
        for i, (name, db) in enumerate(SCORED_TABLES):
            c.node(name, "Table", db)
            c.edge(name, POLICY[0], "GOVERNED_BY", db, POLICY[1])
            for other, other_db in SCORED_TABLES[i + 1 :]:
                c.edge(name, other, "JOIN on IGA", db, other_db)
    elif tool in ("list_concepts", "list_tables", "search", "semantic_concept_search", "find_columns"):
        for r in rows:
            c.node(get(r, "name"), "Concept" if tool == "list_concepts" else kind(r, "label"), get(r, "database"))
    elif tool in ("concept_links", "node_details"):
        for r in rows:
            name, db = get(r, "concept", "name"), get(r, "concept_database", "database")
            c.node(name, "Concept" if tool == "concept_links" else kind(r, "label"), db)
            c.node(get(r, "n_name"), kind(r, "n_label"), get(r, "n_database"))
            c.edge(name, get(r, "n_name"), get(r, "relationship"), db, get(r, "n_database"))
    elif tool == "subgraph":
        for r in rows:
            if "relationship" in r:
                c.edge(get(r, "src"), get(r, "dst"), get(r, "relationship"))
            else:
                c.node(get(r, "name"), kind(r, "label"), get(r, "database"))
    elif tool == "shared_concepts":
        for r in rows:
            for db in r.get("databases") or [get(r, "database")]:
                c.node(get(r, "name"), "Concept", db)
    elif tool == "trace_cross_db":
        for r in rows:
            if r.get("via_node"):
                c.node(r["via_node"], "Table", get(r, "via_db"))
                c.edge(r["via_node"], get(r, "n_name"), get(r, "rel2"), get(r, "via_db"), get(r, "n_database"))
            c.node(get(r, "n_name"), kind(r, "n_label"), get(r, "n_database"))
    elif tool == "find_join_keys":
        for r in rows:
            own = r.get("tables") or []
            for i, a in enumerate(own):
                c.node(a, "Table")
                for b in own[i + 1 :]:
                    c.edge(a, b, f"JOIN on {r.get('column')}")
    return {"nodes": list(c.nodes.values()), "edges": list(c.edges.values())}


_NODE = "struct<name:string,type:string,database:string>"
_EDGE = "struct<source:string,target:string,label:string,source_db:string,target_db:string>"


def shown(tool: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (name, type, database) and edges (source, target, label, source_db, target_db) that a tool's table shows.

    As ``graph_hints``, for tables of any size: each row gives its elements,
    which are reduced to one for each name and database before they are shuffled.
    """
    have = set(rows.columns)
    text = lambda *names: F.coalesce(*[F.when(F.col(n) != "", F.col(n).cast("string")) for n in names if n in have], F.lit(""))
    kind = lambda *names: F.when(text(*names).isin("Concept", "Policy"), text(*names)).otherwise("Table")
    node = lambda name, type_, db: F.struct(name.alias("name"), type_.alias("type"), db.alias("database")).cast(_NODE)
    edge = lambda a, b, label, a_db, b_db: F.struct(a.alias("source"), b.alias("target"), label.alias("label"), a_db.alias("source_db"), b_db.alias("target_db")).cast(_EDGE)
    none = F.lit("")
    nodes, edges = F.array().cast(f"array<{_NODE}>"), F.array().cast(f"array<{_EDGE}>")
    if tool in ("list_concepts", "list_tables", "search", "semantic_concept_search", "find_columns"):
        nodes = F.array(node(text("name"), F.lit("Concept") if tool == "list_concepts" else kind("label"), text("database")))
    elif tool in ("concept_links", "node_details"):
        name, db = text("concept", "name"), text("concept_database", "database")
        nodes = F.array(node(name, F.lit("Concept") if tool == "concept_links" else kind("label"), db), node(text("n_name"), kind("n_label"), text("n_database")))
        edges = F.array(edge(name, text("n_name"), text("relationship"), db, text("n_database")))
    elif tool == "subgraph" and "relationship" in have:
        edges = F.array(edge(text("src"), text("dst"), text("relationship"), none, none))
    elif tool == "subgraph":
        nodes = F.array(node(text("name"), kind("label"), text("database")))
    elif tool == "shared_concepts":
        own = F.coalesce("databases", F.array(text("database"))) if "databases" in have else F.array(text("database"))
        nodes = F.transform(own, lambda db: node(text("name"), F.lit("Concept"), db))
    elif tool == "trace_cross_db":
        to = node(text("n_name"), kind("n_label"), text("n_database"))
        nodes = F.array(node(text("via_node"), F.lit("Table"), text("via_db")), to)
        edges = F.array(edge(text("via_node"), text("n_name"), text("rel2"), text("via_db"), text("n_database")))
    elif tool == "find_join_keys":
        own = F.coalesce("tables", F.array().cast("array<string>"))
        nodes = F.transform(own, lambda x: node(x, F.lit("Table"), none))
        after = lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: edge(x, y, F.concat(F.lit("JOIN on "), text("column")), none, none))
        edges = F.flatten(F.transform(own, after))
    each = rows.select(F.explode(nodes).alias("x")).select("x.*").where("name <> ''")
    lines = rows.select(F.explode(edges).alias("x")).select("x.*").where("source <> '' and target <> ''")
    return each.groupBy("name", "database").agg(F.min("type").alias("type")), lines.distinct()


def is_graph(df: DataFrame) -> bool:
    """Whether a result is drawn as a graph: it has (id, label) or (src, dst)."""
    have = {c.lower() for c in df.columns}
    return {"id", "label"} <= have or {"src", "dst"} <= have


def elements_of_paths(paths: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct vertices and edges of rows with ``path`` (ids) and ``rels``."""
    ids = paths.select(F.explode("path").alias("id")).distinct()
    steps = paths.select(F.explode(F.expr("transform(rels, (r, i) -> named_struct('src', path[i], 'relationship', r, 'dst', path[i + 1]))")).alias("e"))
    return ids.join(vertices, "id"), steps.select("e.*").distinct()


def induced_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges with both ends among ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()


def endpoint_vertices(edges: DataFrame, vertices: DataFrame, most: int | None = 100) -> DataFrame:
    """The vertices of the edges' ends; an end without a vertex is a stub labelled unknown."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    ends = ends if most is None else ends.orderBy("id").limit(most)
    return ends.join(vertices.select("id", "label", "name"), "id", "left").withColumn("label", F.coalesce("label", F.lit("unknown")))


def named(vertices: DataFrame) -> DataFrame:
    """Adds ``shown``, the name to display."""
    col = lambda c: F.col(c) if c in vertices.columns else F.lit(None).cast("string")
    return vertices.withColumn("shown", display_name(col("display_name"), col("name"), col("title"), col("topic_summary"), col("id")))


def labels(vertices: DataFrame) -> DataFrame:
    return vertices.select("label").distinct().orderBy("label")
