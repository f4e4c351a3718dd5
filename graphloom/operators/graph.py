"""Property graphs as two tables, and the queries on metadata graphs.

``vertices``: id, label, database, name, display_name, description, columns
(array<string>), primary_keys, concepts, source_tables, key_columns
(array<string>), ...  ``edges``: src, dst, relationship, description,
similarity_score, method.  Joins are on ids; a name that several databases use
gives several roots, and results carry the database.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import contains_ci
from graphloom.operators.trigrams import TrigramIndex
from graphloom.scratch import materialize

MAX_SUBGRAPH_DEPTH = 4
MAX_PATH_DEPTH = 10
SEARCH_LIMIT = 20
TWO_HOP_LIMIT = 50
#: Ids of a frontier that are sent to the tasks, at most (some MB); larger ones are joined by a shuffle.
MOST_SENT = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, with ``outgoing``; a loop is there once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest, F.lit(False).alias("outgoing"))
    return edges.select("src", "dst", *rest, F.lit(True).alias("outgoing")).unionByName(back)


def column_names(c: Column) -> Column:
    """JSON of a list of names, or of objects with a ``column`` field, as names; what can't be read is an empty list."""
    parts = F.from_json(c, "array<string>")
    name = lambda x: F.coalesce(F.get_json_object(x, "$.column"), x)
    return F.coalesce(F.transform(parts, name), F.array().cast("array<string>"))


class PropertyGraph:
    def __init__(self, vertices: DataFrame, edges: DataFrame, index: TrigramIndex | None = None):
        self.vertices, self.edges, self.index = vertices, edges, index

    @property
    def both_ways(self) -> DataFrame:
        return undirected(self.edges.select("src", "dst", "relationship"))

    def _as(self, prefix: str, *cols: str) -> DataFrame:
        """The vertices with prefixed columns, for joins."""
        return self.vertices.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("id", *cols)])

    def _links(self, start: DataFrame, *cols: str) -> DataFrame:
        """(start's columns) x (its neighbours, as ``n_*``)."""
        u = self.both_ways.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), "relationship", "outgoing")
        return start.join(u, F.col("id") == F.col("_src")).join(self._as("n", *cols), F.col("_dst") == F.col("n_id")).drop("_src", "_dst")

    def schema(self) -> DataFrame:
        """(kind, name, n): vertex labels, relationship types and the total of edges."""
        v = self.vertices.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("vertex").alias("kind"), F.col("label").alias("name"), "n")
        e = self.edges.groupBy("relationship").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("relationship").alias("name"), "n")
        return v.unionByName(e).unionByName(self.edges.agg(F.lit("total").alias("kind"), F.lit("edges").alias("name"), F.count("*").alias("n"))).orderBy("kind", "name")

    def list_concepts(self) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        return self.vertices.where("label = 'Concept'").select("id", text("name"), text("description"), text("database"), "source_tables", "key_columns").orderBy("name", "database")

    def list_tables(self, database: str | None = None) -> DataFrame:
        out = self.vertices.where("label = 'Table'")
        return (out if database is None else out.where(F.col("database") == database)).orderBy("database", "name")

    def concept_links(self, concept: str, database: str | None = None) -> DataFrame:
        """One row for each neighbour of the concepts of that name: its relationship, label, name and database."""
        start = self.vertices.where((F.col("label") == "Concept") & (F.lower("name") == concept.lower()))
        if database is not None:
            start = start.where(F.col("database") == database)
        start = start.select("id", F.col("name").alias("concept"), F.col("database").alias("concept_database"))
        return self._links(start, "label", "name", "database").where("n_label in ('Table', 'Concept')")

    def concept_links_nested(self, concept: str, database: str | None = None) -> DataFrame:
        """One row for each concept: linked tables, the databases of those, and related concepts."""
        item = F.struct("n_name", "n_database", "relationship")
        return self.concept_links(concept, database).groupBy("id", "concept", "concept_database").agg(
            F.sort_array(F.collect_list(F.when(F.col("n_label") == "Table", item))).alias("linked_tables"),
            F.sort_array(F.collect_set(F.when(F.col("n_label") == "Table", F.col("n_database")))).alias("linked_databases"),
            F.sort_array(F.collect_list(F.when(F.col("n_label") == "Concept", item))).alias("related_concepts"),
        )

    def node_details(self, name: str) -> DataFrame:
        """The neighbours of the nodes of that name, with the direction; no row if there is none."""
        start = self.vertices.where(F.col("name") == name).select("id", "label", "name", "database")
        return self._links(start, "label", "name", "database").orderBy("relationship", "n_name", "n_database")

    def cross_db_edges(self) -> DataFrame:
        out = self.edges.join(self._as("s", "name", "database"), F.col("src") == F.col("s_id")).join(self._as("t", "name", "database"), F.col("dst") == F.col("t_id"))
        return out.where("s_database <> t_database").orderBy("s_database", "t_database", "relationship", "s_name", "t_name")

    def indexed(self, path: str) -> PropertyGraph:
        """The graph with a stored index of trigrams, which ``search`` and ``find_columns`` then read instead of all vertices."""
        fields = [c for c in ("name", "display_name", "description", "columns", "key_columns") if c in self.vertices.columns]
        return PropertyGraph(self.vertices, self.edges, TrigramIndex.build(self.vertices, path, fields))

    def narrowed(self, keywords: list[str], fields: list[str]) -> DataFrame:
        """The vertices that may hold a keyword: by the index if there is one, or else all."""
        return self.vertices if self.index is None else self.index.narrowed(self.vertices, keywords, fields)

    def search(self, keyword: str, limit: int = SEARCH_LIMIT, database: str | None = None, reference_order: bool = False) -> DataFrame:
        """Substring search in name, display name and description, in any case; names that hit come first.

        ``database`` filters before the limit, or after it with ``reference_order``.
        """
        hit = contains_ci(F.col("name"), keyword)
        any_ = hit | contains_ci(F.col("display_name"), keyword) | contains_ci(F.col("description"), keyword)
        own = F.lit(True) if database is None else F.col("database") == database
        out = self.narrowed([keyword], ["name", "display_name", "description"]).where(any_ if reference_order else any_ & own).withColumn("name_hit", hit)
        out = out.orderBy(F.when(F.col("name_hit"), 0).otherwise(1), "name", "database").limit(limit)
        return out.where(own) if reference_order else out

    def _near(self, front: DataFrame, size: int) -> DataFrame:
        """(id, _from) of the neighbours of a frontier; a small one is sent to the tasks that read the edges, which then aren't shuffled."""
        sent = F.broadcast(front) if size <= MOST_SENT else front
        ends = self.edges.select("src", "dst")
        out = ends.join(sent.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.col("src").alias("_from"))
        back = ends.join(sent.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.col("dst").alias("_from"))
        return out.unionByName(back)

    def _level(self, levels: list[DataFrame], size: int) -> tuple[DataFrame, int]:
        """The next level of a search and its size: neighbours of the last that are in none; written, else the plan would double with every hop."""
        seen = reduce(DataFrame.unionByName, levels)
        new = materialize(self._near(levels[-1], size).select("id").distinct().join(seen, "id", "left_anti"), "search-level")
        return new, new.count()

    def _reach(self, roots: DataFrame, depth: int) -> DataFrame:
        """(id, depth) of what can be reached in at most ``depth`` hops, each at its least depth."""
        levels = [materialize(roots.select("id").distinct(), "search-level")]
        size = levels[0].count()
        while len(levels) <= depth and size:
            level, size = self._level(levels, size)
            levels.append(level)
        return reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(d)) for d, x in enumerate(levels)])

    def subgraph(self, name: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Nodes within ``depth`` hops (4 at most), the root first, and the edges between them in their own direction."""
        reached = self._reach(self.vertices.where(F.col("name") == name).select("id"), min(depth, MAX_SUBGRAPH_DEPTH))
        nodes = self.vertices.join(reached, "id").orderBy("depth", "name", "database")
        ids = reached.select("id")
        ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return nodes, edges.select("src", "relationship", "dst").distinct()

    def path_between(self, start: str, end: str, max_depth: int = MAX_PATH_DEPTH) -> DataFrame:
        """One shortest path as hops (hop, from_id, relationship, to_id); of several the least by ids, no row if there is none."""
        return self.search_path(start, end, max_depth)[0]

    def search_path(self, start: str, end: str, max_depth: int = MAX_PATH_DEPTH) -> tuple[DataFrame, dict[str, int]]:
        """The path of ``path_between``, and how many vertices were reached from either end.

        The search grows from both ends, each time from the one whose frontier has
        fewer edges, until the frontiers meet.  Levels hold ids only; the path is then
        walked from the start, at each hop to the least id that is on a shortest way.
        """
        named = lambda name: materialize(self.vertices.where(F.col("name") == name).select("id").distinct(), "search-level")
        sides = [[named(start)], [named(end)]]
        sizes = [[x[0].count()] for x in sides]
        meet = materialize(sides[0][0].join(sides[1][0], "id", "left_semi"), "search-meet")
        most = min(max_depth, MAX_PATH_DEPTH)
        costs = [self._near(x[0], n[0]).count() for x, n in zip(sides, sizes, strict=True)]
        while sizes[0][-1] and sizes[1][-1] and meet.isEmpty() and len(sides[0]) + len(sides[1]) - 2 < most:
            k = 0 if costs[0] <= costs[1] else 1
            level, n = self._level(sides[k], sizes[k][-1])
            sides[k].append(level)
            sizes[k].append(n)
            costs[k] = self._near(level, n).count()
            meet = materialize(sides[0][-1].join(sides[1][-1], "id", "left_semi"), "search-meet")
        told = {"from_start": sum(sizes[0]), "from_end": sum(sizes[1])}
        kind = self.vertices.schema["id"].dataType.simpleString()
        schema = f"hop int, from_id {kind}, relationship string, to_id {kind}"
        if meet.isEmpty():
            return self.vertices.sparkSession.createDataFrame([], schema), told
        # of the levels from the start only what leads to where the frontiers met
        on_way = [meet]
        for level in reversed(sides[0][:-1]):
            on_way.insert(0, materialize(level.join(self._near(on_way[0], on_way[0].count()).select("id").distinct(), "id", "left_semi"), "search-way"))
        way = on_way + sides[1][-2::-1]
        at = way[0].agg(F.min("id").alias("id")).first()["id"]
        hops = []
        for hop, level in enumerate(way[1:], 1):
            own = self.edges.where(F.col("src") == at).select(F.col("dst").alias("id"), "relationship").unionByName(self.edges.where(F.col("dst") == at).select(F.col("src").alias("id"), "relationship"))
            step = own.join(level, "id", "left_semi").agg(F.min(F.struct("id")).alias("to"), F.min(F.struct("id", "relationship")).alias("both")).first()
            hops.append((hop, at, step["both"]["relationship"], step["to"]["id"]))
            at = step["to"]["id"]
        return self.vertices.sparkSession.createDataFrame(hops, schema), told

    def find_columns(self, column: str) -> DataFrame:
        """Tables and concepts with a column whose name has the text in it."""
        hit = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: contains_ci(x, column))
        matched = F.when(F.col("label") == "Table", hit("columns")).when(F.col("label") == "Concept", hit("key_columns"))
        return self.narrowed([column], ["columns", "key_columns"]).withColumn("matched", matched).where(F.size("matched") > 0).select("id", "label", "database", "name", "matched").orderBy("database", "name")

    def shared_concepts(self) -> tuple[DataFrame, DataFrame]:
        """Names used by concepts of several databases, and concepts linked to concepts of other databases."""
        concepts = self.vertices.where("label = 'Concept'")
        same = concepts.groupBy("name").agg(F.sort_array(F.collect_set("database")).alias("databases")).where(F.size("databases") > 1)
        across = self._links(concepts.select("id", "name", "database"), "label", "name", "database").where("n_label = 'Concept' and n_database <> database")
        linked = across.groupBy("name", "database").agg(F.sort_array(F.collect_set("n_database")).alias("linked_databases"), F.count_distinct("n_id").alias("linked_count"))
        return same, linked

    def database_summary(self, database: str) -> tuple[DataFrame, DataFrame]:
        """The database's tables by their number of edges, and the concepts they are connected to."""
        tables = self.vertices.where((F.col("label") == "Table") & (F.col("database") == database)).select("id", "name")
        degree = self.both_ways.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("connections"))
        ranked = tables.join(degree, "id", "left").fillna(0, ["connections"]).orderBy(F.desc("connections"), "name")
        concepts = self._links(tables, "label", "name", "database").where("n_label = 'Concept'").select(F.col("n_name").alias("concept"), F.col("n_database").alias("concept_database")).distinct()
        return ranked, concepts

    def trace_cross_db(self, name: str, target: str) -> tuple[DataFrame, DataFrame]:
        """Neighbours of the node in the target database, and its nodes two hops away (50 at most)."""
        start = self.vertices.where(F.col("name") == name).select("id", F.col("database").alias("source_db"))
        one = self._links(start, "label", "name", "database")
        direct = one.where(F.col("n_database") == target).orderBy("n_name", "relationship")
        mid = one.where("n_id <> id").select(F.col("id").alias("start_id"), F.col("n_id").alias("id"), F.col("relationship").alias("rel1"), F.col("n_name").alias("via_node"), F.col("n_database").alias("via_db"))
        two = self._links(mid, "label", "name", "database").where((F.col("n_database") == target) & (F.col("n_id") != F.col("start_id")) & (F.col("n_id") != F.col("id")))
        two = two.withColumnRenamed("relationship", "rel2").orderBy("n_name", "via_node", "rel1", "rel2").limit(TWO_HOP_LIMIT)
        return direct, two

    def query(self, spark: SparkSession, text: str) -> DataFrame:
        """SQL on the views ``vertices`` and ``edges``; reading only."""
        from graphloom.operators.sqlguard import run_on

        return run_on(spark, {"vertices": self.vertices, "edges": self.edges}, text)

    def counts_by_database(self) -> DataFrame:
        return self.vertices.groupBy("database", "label").agg(F.count("*").alias("n"))

    def hubs(self, limit: int = 10) -> DataFrame:
        """The tables with the most edges."""
        return degrees(self).join(self.vertices.where("label = 'Table'").select("id", "name", "database"), "id").orderBy(F.desc("degree"), "database", "name").limit(limit)

    def concept_tables(self) -> DataFrame:
        """Each concept's tables and their number, the most first."""
        links = self._links(self.vertices.where("label = 'Concept'").select("id", "name", "database"), "label", "name").where("n_label = 'Table'")
        return links.groupBy("name", "database").agg(F.sort_array(F.collect_list("n_name")).alias("tables"), F.count("*").alias("n")).orderBy(F.desc("n"), "name", "database")


# -- checks and comparison of graphs


def degrees(g: PropertyGraph) -> DataFrame:
    """(id, degree) of every vertex; a loop counts twice."""
    ends = g.edges.select(F.col("src").alias("id")).unionAll(g.edges.select(F.col("dst").alias("id")))
    return g.vertices.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def isolated(g: PropertyGraph) -> DataFrame:
    ends = g.edges.select(F.col("src").alias("id")).unionAll(g.edges.select(F.col("dst").alias("id")))
    return g.vertices.join(ends, "id", "left_anti")


def self_loops(g: PropertyGraph) -> DataFrame:
    return g.edges.where("src = dst").join(g.vertices.select(F.col("id").alias("src"), "name", "database"), "src")


def counts(g: PropertyGraph) -> DataFrame:
    """One row: nodes, tables, concepts, edges."""
    v = g.vertices.agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Table").alias("tables"), F.count_if(F.col("label") == "Concept").alias("concepts"))
    return v.join(g.edges.agg(F.count("*").alias("edges")))


def named_edges(g: PropertyGraph) -> DataFrame:
    """(src_db, src_name, relationship, dst_db, dst_name) of every edge."""
    s, t = g._as("src", "database", "name"), g._as("dst", "database", "name")
    out = g.edges.join(s, F.col("src") == F.col("src_id")).join(t, F.col("dst") == F.col("dst_id"))
    return out.select(F.col("src_database").alias("src_db"), "src_name", "relationship", F.col("dst_database").alias("dst_db"), "dst_name")


def set_difference(a: DataFrame, b: DataFrame, sides: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Distinct rows of one side only, with ``only_in``."""
    return a.subtract(b).withColumn("only_in", F.lit(sides[0])).unionByName(b.subtract(a).withColumn("only_in", F.lit(sides[1])))


def relationship_distribution(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """(relationship, left_count, right_count), by a full outer join."""
    n = lambda g, c: g.edges.groupBy("relationship").agg(F.count("*").alias(c))
    return n(a, "left_count").join(n(b, "right_count"), "relationship", "full").fillna(0, ["left_count", "right_count"])


def parity_report(a: PropertyGraph, b: PropertyGraph, first: int = 10) -> dict[str, DataFrame]:
    """What differs between two graphs, by section; the first ten of each difference, in order."""
    keyed = lambda g, label: g.vertices.where(F.col("label") == label).select("database", "name")
    head = lambda df: df.orderBy("only_in", *[c for c in df.columns if c != "only_in"]).limit(first)
    deg = lambda g, c: degrees(g).join(g.vertices.select("id", "database", "name"), "id").select("database", "name", F.col("degree").alias(c))
    names = lambda g: g.vertices.where("label = 'Table'").select("database", "name", F.col("display_name"))
    both = names(a).join(names(b).withColumnRenamed("display_name", "other_name"), ["database", "name"])
    return {
        "counts": counts(a).withColumn("side", F.lit("left")).unionByName(counts(b).withColumn("side", F.lit("right"))),
        "databases": head(set_difference(a.vertices.select("database").distinct(), b.vertices.select("database").distinct())),
        "tables": head(set_difference(keyed(a, "Table"), keyed(b, "Table"))),
        "table_labels": both.where("not (display_name <=> other_name)").orderBy("database", "name").limit(first),
        "concepts": head(set_difference(keyed(a, "Concept"), keyed(b, "Concept"))),
        "relationships": relationship_distribution(a, b).where("left_count <> right_count"),
        "edges": head(set_difference(named_edges(a), named_edges(b))),
        "degrees": deg(a, "left_degree").join(deg(b, "right_degree"), ["database", "name"]).where("left_degree <> right_degree"),
        "isolated": head(set_difference(isolated(a).select("database", "name"), isolated(b).select("database", "name"))),
        "self_loops": head(set_difference(self_loops(a).select("database", "name", "relationship"), self_loops(b).select("database", "name", "relationship"))),
    }


def merge_parts(parts: list[PropertyGraph]) -> PropertyGraph:
    return PropertyGraph(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.vertices for p in parts]), reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.edges for p in parts]))
