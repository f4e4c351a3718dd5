"""The metadata graph, its comparison, and unification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph as gr
from graphloom.operators import joinkeys, unify
from graphloom.operators.trigrams import TrigramIndex
from graphloom.plans.registry import Tables, query
from graphloom.scratch import materialize, shared_dir


def _listed(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "")


def _graph(t: Tables, links: str = "links") -> gr.PropertyGraph:
    v = t.catalog.select("id", "label", "database", "name", "display_name", "description", _listed("columns_csv").alias("columns"), F.filter(F.array("primary_key"), lambda x: x != "").alias("primary_keys"), _listed("source_tables_csv").alias("source_tables"), _listed("key_columns_csv").alias("key_columns"))
    return gr.PropertyGraph(v, getattr(t, links))


def _stored(t: Tables) -> gr.PropertyGraph:
    """The graph as written tables, for queries that read its edges many times."""
    g = _graph(t)
    return gr.PropertyGraph(materialize(g.vertices, "graph-vertices"), materialize(g.edges, "graph-edges"))


@query("q24_graph_schema", "SELECT 'vertex' AS kind, label AS name, count(*) AS n FROM {catalog} GROUP BY label UNION ALL SELECT 'edge', relationship, count(*) FROM {links} GROUP BY relationship UNION ALL SELECT 'total', 'edges', count(*) FROM {links}")
def q24(t):
    return _graph(t).schema()


@query("q25_list_concepts", "SELECT name, database, description, source_tables_csv AS source_tables FROM {catalog} WHERE label = 'Concept'")
def q25(t):
    return _graph(t).list_concepts().select("name", "database", "description", F.array_join("source_tables", ",").alias("source_tables"))


_NEAR = "SELECT a.name AS concept, a.database AS concept_database, u.relationship, b.label AS n_label, b.name AS n_name, b.database AS n_database FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.label = 'Concept' AND lower(a.name) = 'topic 12'"


@query("q26_concept_links", _NEAR)
def q26(t):
    return _graph(t).concept_links("topic 12").select("concept", "concept_database", "relationship", "n_label", "n_name", "n_database")


@query("q27_node_details", "SELECT a.name, a.database, u.relationship, u.outgoing, b.label AS n_label, b.name AS n_name, b.database AS n_database FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.name = 'Supplier#000000001'")
def q27(t):
    return _graph(t).node_details("Supplier#000000001").select("name", "database", "relationship", "outgoing", "n_label", "n_name", "n_database")


@query("q28_list_tables", "SELECT database, name, display_name, columns_csv AS columns FROM {catalog} WHERE label = 'Table' AND database = 'corpus'")
def q28(t):
    return _graph(t).list_tables("corpus").select("database", "name", "display_name", F.array_join("columns", ",").alias("columns"))


@query("q29_cross_db_edges", "SELECT s.database AS s_database, s.name AS s_name, e.relationship, t.database AS t_database, t.name AS t_name FROM {links} e JOIN {catalog} s ON e.src = s.id JOIN {catalog} t ON e.dst = t.id WHERE s.database <> t.database")
def q29(t):
    return _graph(t).cross_db_edges().select("s_database", "s_name", "relationship", "t_database", "t_name")


_FOUND = "er#00000001"


@query(
    "q30_search",
    f"""SELECT id, name, database, contains(lower(name), '{_FOUND}') AS name_hit FROM {{catalog}}
    WHERE contains(lower(name), '{_FOUND}') OR contains(lower(display_name), '{_FOUND}') OR contains(lower(description), '{_FOUND}') ORDER BY name_hit DESC, name, database LIMIT 20""",
)
def q30(t):
    return _graph(t).search(_FOUND.upper()).select("id", "name", "database", "name_hit")


_REACH = """WITH RECURSIVE reach AS (SELECT id, 0 AS depth FROM {catalog} WHERE name = 'Supplier#000000001' UNION SELECT u.dst, r.depth + 1 FROM reach r JOIN {both_ways} u ON u.src = r.id WHERE r.depth < 2),
  near AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"""


@query("q31_subgraph_2hop", _REACH + " SELECT 'node' AS kind, id AS a, depth::VARCHAR AS rel, '' AS b FROM near UNION ALL SELECT DISTINCT 'edge', src, relationship, dst FROM {links} WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)")
def q31(t):
    nodes, edges = _stored(t).subgraph("Supplier#000000001", 2)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("depth").cast("string").alias("rel"), F.lit("").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("relationship").alias("rel"), F.col("dst").alias("b")))


def _path_sql(start: str, end: str, most: int) -> str:
    """The least shortest path: distances to the end, and from the start the least next id that is one nearer."""
    return f"""WITH RECURSIVE near AS (SELECT id, 0 AS d FROM {{catalog}} WHERE name = '{end}' UNION SELECT u.src, n.d + 1 FROM near n JOIN {{both_ways}} u ON u.dst = n.id WHERE n.d < {most}),
    far AS (SELECT id, min(d) AS d FROM near GROUP BY id),
    step AS (SELECT u.src, min(u.dst) AS dst FROM {{both_ways}} u JOIN far a ON a.id = u.src JOIN far b ON b.id = u.dst AND b.d = a.d - 1 GROUP BY u.src),
    walk AS (SELECT 1 AS hop, s.src, s.dst FROM step s JOIN {{catalog}} c ON c.id = s.src AND c.name = '{start}' UNION ALL SELECT w.hop + 1, s.src, s.dst FROM walk w JOIN step s ON s.src = w.dst)
    SELECT CAST(w.hop AS BIGINT) AS hop, w.src AS from_id, (SELECT min(relationship) FROM {{both_ways}} u WHERE u.src = w.src AND u.dst = w.dst) AS relationship, w.dst AS to_id FROM walk w"""


@query("q32_shortest_path", _path_sql("Supplier#000000001", "NATION_7", 6))
def q32(t):
    return _stored(t).path_between("Supplier#000000001", "NATION_7").select(F.col("hop").cast("long").alias("hop"), "from_id", "relationship", "to_id")


@query("q33_find_columns", "SELECT id, label, database, name, array_to_string(list_filter(string_split(CASE WHEN label = 'Table' THEN columns_csv ELSE key_columns_csv END, ','), lambda x: contains(x, 'orderkey')), ',') AS matched FROM {catalog} WHERE contains(CASE WHEN label = 'Table' THEN columns_csv ELSE key_columns_csv END, 'orderkey')")
def q33(t):
    return _graph(t).find_columns("OrderKey").select("id", "label", "database", "name", F.array_join("matched", ",").alias("matched"))


@query(
    "q34_shared_concepts",
    """SELECT 'same_name' AS bridge, name, '' AS database, string_agg(DISTINCT database, ',' ORDER BY database) AS databases, count(DISTINCT database) AS n FROM {catalog} WHERE label = 'Concept' GROUP BY name HAVING count(DISTINCT database) > 1
    UNION ALL SELECT 'cross_edge', a.name, a.database, string_agg(DISTINCT b.database, ',' ORDER BY b.database), count(DISTINCT b.id) FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.label = 'Concept' AND b.label = 'Concept' AND a.database <> b.database GROUP BY a.name, a.database""",
)
def q34(t):
    same, linked = _graph(t).shared_concepts()
    a = same.select(F.lit("same_name").alias("bridge"), "name", F.lit("").alias("database"), F.array_join("databases", ",").alias("databases"), F.size("databases").cast("long").alias("n"))
    return a.unionByName(linked.select(F.lit("cross_edge").alias("bridge"), "name", "database", F.array_join("linked_databases", ",").alias("databases"), F.col("linked_count").alias("n")))


@query(
    "q35_db_summary",
    """SELECT 'table' AS kind, c.name, c.database, count(u.src) AS n FROM {catalog} c LEFT JOIN {both_ways} u ON u.src = c.id WHERE c.label = 'Table' AND c.database = 'core' GROUP BY ALL
    UNION ALL SELECT DISTINCT 'concept', b.name, b.database, 0 FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.label = 'Table' AND a.database = 'core' AND b.label = 'Concept'""",
)
def q35(t):
    tables, concepts = _graph(t).database_summary("core")
    return tables.select(F.lit("table").alias("kind"), "name", F.lit("core").alias("database"), F.col("connections").alias("n")).unionByName(concepts.select(F.lit("concept").alias("kind"), F.col("concept").alias("name"), F.col("concept_database").alias("database"), F.lit(0).cast("long").alias("n")))


@query(
    "q36_trace_cross_db",
    """SELECT 'direct' AS kind, '' AS via, '' AS rel1, u.relationship AS rel2, b.name AS target FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.name = 'Customer#000000001' AND b.database = 'stream'
    UNION ALL (SELECT 'two_hop', m.name, u.relationship, w.relationship, b.name FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} m ON m.id = u.dst JOIN {both_ways} w ON w.src = m.id JOIN {catalog} b ON b.id = w.dst
    WHERE a.name = 'Customer#000000001' AND m.id <> a.id AND b.id <> a.id AND b.id <> m.id AND b.database = 'stream' ORDER BY b.name, m.name, u.relationship, w.relationship LIMIT 50)""",
)
def q36(t):
    direct, two = _graph(t).trace_cross_db("Customer#000000001", "stream")
    blank = F.lit("")
    return direct.select(F.lit("direct").alias("kind"), blank.alias("via"), blank.alias("rel1"), F.col("relationship").alias("rel2"), F.col("n_name").alias("target")).unionByName(two.select(F.lit("two_hop").alias("kind"), F.col("via_node").alias("via"), "rel1", "rel2", F.col("n_name").alias("target")))


# -- the instance graph


def _places(t: Tables) -> gr.PropertyGraph:
    e = t.places
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return gr.PropertyGraph(ids, e)


@query("q37_degree", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {places} UNION ALL SELECT dst FROM {places}) x GROUP BY id")
def q37(t):
    return gr.degrees(_places(t))


@query("q38_isolated", "SELECT id, name, database FROM {catalog} WHERE id NOT IN (SELECT src FROM {links}) AND id NOT IN (SELECT dst FROM {links})")
def q38(t):
    return gr.isolated(_graph(t)).select("id", "name", "database")


@query("q39_self_loops", "SELECT e.src, e.relationship, c.name, c.database FROM {links} e JOIN {catalog} c ON c.id = e.src WHERE e.src = e.dst")
def q39(t):
    return gr.self_loops(_graph(t)).select("src", "relationship", "name", "database")


_NAMED = "SELECT s.database AS src_db, s.name AS src_name, e.relationship, d.database AS dst_db, d.name AS dst_name FROM {{{0}}} e JOIN {{catalog}} s ON e.src = s.id JOIN {{catalog}} d ON e.dst = d.id"


@query("q40_edge_diff", f"WITH a AS ({_NAMED.format('links')}), b AS ({_NAMED.format('links2')}) SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def q40(t):
    return gr.set_difference(gr.named_edges(_graph(t)), gr.named_edges(_graph(t, "links2")))


@query("q41_rel_dist_full_outer", "SELECT coalesce(a.relationship, b.relationship) AS relationship, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count FROM (SELECT relationship, count(*) AS n FROM {links} GROUP BY 1) a FULL JOIN (SELECT relationship, count(*) AS n FROM {links2} GROUP BY 1) b ON a.relationship = b.relationship")
def q41(t):
    return gr.relationship_distribution(_graph(t), _graph(t, "links2"))


# -- unification

_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_SIM = f"sim AS (SELECT a.id AS left_id, b.id AS right_id, {_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})) AS similarity FROM {{vec_a}} a CROSS JOIN {{vec_b}} b)"
HI, LO = 0.40, 0.30


@query("q42_cosine_pairs_top", f"WITH {_SIM} SELECT left_id, right_id, round(similarity, 4) AS similarity FROM sim ORDER BY round(similarity, 4) DESC, left_id, right_id LIMIT 20")
def q42(t):
    return unify.most_similar(t.vec_a, t.vec_b, 20)


@query("q43_bucket_counts", f"WITH {_SIM} SELECT CASE WHEN similarity >= {HI} THEN 'auto' WHEN similarity >= {LO} THEN 'candidate' ELSE 'reject' END AS bucket, count(*) AS n FROM sim GROUP BY 1")
def q43(t):
    return unify.bucket_counts(t.vec_a, t.vec_b, HI, LO)


@query("q44_cross_edges", f"WITH {_SIM} SELECT 'a__' || left_id AS src, 'b__' || right_id AS dst, 'RELATED' AS relationship, round(similarity, 4) AS similarity_score, 'embedding' AS method FROM sim WHERE similarity >= {HI}")
def q44(t):
    # no judge is asked, so only the pairs that are linked at once are needed
    pairs = unify.similarities(t.vec_a, t.vec_b, at_least=HI)
    return unify.concept_edges(unify.classify(pairs, HI, LO), "a", "b").select("src", "dst", "relationship", "similarity_score", "method")


_RAW_EDGES = "SELECT CASE WHEN event_id % 5 = 0 THEN 'a__' ELSE '' END || user_id AS src, CASE WHEN event_id % 7 = 0 THEN 'gone' ELSE CAST(event_id % 50 AS VARCHAR) END AS dst, CASE event_id % 4 WHEN 0 THEN 'has-many parts' WHEN 1 THEN '' WHEN 2 THEN lower(event_type) END AS relationship, event_id AS seq FROM {events}"
_RAW_NODES = "SELECT CAST(user_id AS VARCHAR) AS id, event_type AS name, event_id AS seq FROM {events}"


def _raw(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events
    edges = e.selectExpr("concat(CASE WHEN event_id % 5 = 0 THEN 'a__' ELSE '' END, user_id) AS src", "CASE WHEN event_id % 7 = 0 THEN 'gone' ELSE CAST(event_id % 50 AS STRING) END AS dst", "CASE event_id % 4 WHEN 0 THEN 'has-many parts' WHEN 1 THEN '' WHEN 2 THEN lower(event_type) END AS relationship", "event_id AS seq")
    return e.selectExpr("CAST(user_id AS STRING) AS id", "event_type AS name", "event_id AS seq"), edges


_SPACED = f"ns AS (SELECT DISTINCT id AS old_id, 'a__' || id AS new_id FROM ({_RAW_NODES}) n), es AS (SELECT coalesce(s.new_id, e.src) AS src, coalesce(d.new_id, e.dst) AS dst, e.relationship, e.seq FROM ({_RAW_EDGES}) e LEFT JOIN ns s ON e.src = s.old_id LEFT JOIN ns d ON e.dst = d.old_id)"


@query("q45_namespace_merge", f"WITH {_SPACED} SELECT src, dst, count(*) AS n FROM es GROUP BY src, dst")
def q45(t):
    return unify.namespace(*_raw(t), "a")[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("q46_keep_last_dedup", f"SELECT id, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ({_RAW_NODES}) n) x WHERE rn = 1")
def q46(t):
    return unify.keep_last(_raw(t)[0]).select("id", "name", "seq")


_CLEAN = "CASE WHEN regexp_replace(upper(trim(coalesce(relationship, ''))), '[^A-Z0-9_]', '_', 'g') = '' THEN 'RELATED_TO' ELSE regexp_replace(upper(trim(coalesce(relationship, ''))), '[^A-Z0-9_]', '_', 'g') END"


@query("q47_edge_normalise_dedup", f"WITH {_SPACED}, c AS (SELECT src, dst, {_CLEAN} AS relationship, seq FROM es WHERE src IN (SELECT new_id FROM ns) AND dst IN (SELECT new_id FROM ns)) SELECT src, relationship, dst, min(seq) AS seq FROM c GROUP BY ALL")
def q47(t):
    nodes, edges = unify.namespace(*_raw(t), "a")
    return unify.clean_edges(edges, unify.keep_last(nodes))[0].select("src", "relationship", "dst", "seq")


@query(
    "q48_derived_relates_to",
    """SELECT DISTINCT t.id AS src, c.id AS dst, 'RELATES_TO' AS relationship FROM (SELECT id, database, unnest(string_split(source_tables_csv, ',')) AS tn FROM {catalog} WHERE label = 'Concept') c JOIN {catalog} t ON t.label = 'Table' AND t.database = c.database AND t.name = c.tn
    WHERE NOT EXISTS (SELECT 1 FROM {links} e WHERE e.src = t.id AND e.dst = c.id AND e.relationship = 'RELATES_TO')""",
)
def q48(t):
    g = _graph(t)
    return unify.derived_edges(g.vertices.where("label = 'Concept'"), g.vertices.where("label = 'Table'"), g.edges).select("src", "dst", "relationship")


@query("q49_unify_summary", "SELECT 'database' AS kind, database AS name, count(*) FILTER (label = 'Table') AS tables, count(*) FILTER (label = 'Concept') AS n FROM {catalog} GROUP BY database UNION ALL SELECT 'relationship', relationship, 0, count(*) FROM {links} GROUP BY relationship")
def q49(t):
    g = _graph(t)
    kinds, rels = unify.summary(g.vertices, g.edges)
    return kinds.select(F.lit("database").alias("kind"), F.col("database").alias("name"), "tables", F.col("concepts").alias("n")).unionByName(rels.select(F.lit("relationship").alias("kind"), F.col("relationship").alias("name"), F.lit(0).cast("long").alias("tables"), "n"))


_JK = ["Customer#000000008", "Customer#000000001", "Customer#000000041", "Supplier#000000001"]


@query(
    "q50_join_key_inference",
    """WITH pick AS (SELECT * FROM (VALUES (0, 'Customer#000000008'), (1, 'Customer#000000001'), (2, 'Customer#000000041'), (3, 'Supplier#000000001')) p(ord, tn)),
    cols AS (SELECT p.ord, c.name, c.primary_key, unnest(string_split(c.columns_csv, ',')) AS col, unnest(range(0, len(string_split(c.columns_csv, ',')))) AS pos FROM pick p JOIN {catalog} c ON c.name = p.tn AND c.label = 'Table'),
    k AS (SELECT *, CASE WHEN replace(col, '_', '') LIKE '%id' THEN 'identifier' WHEN col = primary_key THEN 'primary_key' ELSE 'data' END AS class FROM cols)
    SELECT col AS "column", string_agg(name, ',' ORDER BY ord) AS tables, arg_min(class, ord) AS column_type, CASE WHEN arg_min(class, ord) IN ('identifier', 'primary_key') THEN 'HIGH' ELSE 'LOW' END AS confidence FROM k GROUP BY col HAVING count(*) >= 2""",
)
def q50(t):
    wanted = t.spark.createDataFrame(list(enumerate(_JK)), "ord int, name string")
    tables = t.catalog.where("label = 'Table'").join(wanted, "name").select("ord", F.col("name").alias("table_name"), _listed("columns_csv").alias("columns"), "primary_key")
    return joinkeys.shared_columns(tables).select("column", F.array_join("tables", ",").alias("tables"), "column_type", "confidence")


_KW = ["er#00000001", "topic 11", "ring"]
_HIT = lambda c: " + ".join(f"contains(lower({c}), '{k}')::INT" for k in _KW)


@query("q51_semantic_search", f"WITH s AS (SELECT name, database, {' + '.join(f'({_HIT(c)}) * {w}' for c, w in (('description', 2), ('label', 1), ('name', 3)))} AS score, ({_HIT('name')} + {_HIT('display_name')} + {_HIT('description')}) > 0 AS hit FROM {{catalog}}) SELECT name, arg_min(database, database) AS database, arg_min(score, database)::BIGINT AS relevance_score FROM s WHERE hit GROUP BY name ORDER BY relevance_score DESC, name LIMIT 15")
def q51(t):
    return joinkeys.semantic_search(_graph(t), _KW, per_keyword=None).select("name", "database", "relevance_score")


@query("q63_hub_tables", "SELECT c.name, c.database, count(x.id) AS degree FROM {catalog} c LEFT JOIN (SELECT src AS id FROM {links} UNION ALL SELECT dst FROM {links}) x ON x.id = c.id WHERE c.label = 'Table' GROUP BY ALL ORDER BY degree DESC, c.database, c.name LIMIT 10")
def q63(t):
    return _graph(t).hubs().select("name", "database", "degree")


@query("q64_concept_tables", "SELECT a.name, a.database, string_agg(b.name, ',' ORDER BY b.name) AS tables, count(*) AS n FROM {catalog} a JOIN {both_ways} u ON u.src = a.id JOIN {catalog} b ON b.id = u.dst WHERE a.label = 'Concept' AND b.label = 'Table' GROUP BY ALL")
def q64(t):
    return _graph(t).concept_tables().select("name", "database", F.array_join("tables", ",").alias("tables"), "n")


@query("q65_graph_counts", "SELECT count(*) AS nodes, count(*) FILTER (label = 'Table') AS tables, count(*) FILTER (label = 'Concept') AS concepts, (SELECT count(*) FROM {links}) AS edges FROM {catalog}")
def q65(t):
    return gr.counts(_graph(t))


@query("q66_purge_database", "SELECT e.src, e.relationship, e.dst FROM {links} e WHERE e.src NOT IN (SELECT id FROM {catalog} WHERE database = 'stream') AND e.dst NOT IN (SELECT id FROM {catalog} WHERE database = 'stream')")
def q66(t):
    from graphloom.sources.store import purge

    return purge(_graph(t), "stream").edges.select("src", "relationship", "dst")


@query("q70_counts_by_database", "SELECT database, label, count(*) AS n FROM {catalog} GROUP BY database, label")
def q70(t):
    return _graph(t).counts_by_database()


@query("q71_graph_sql", "SELECT s.database, e.relationship, count(*) AS n FROM {links} e JOIN {catalog} s ON e.src = s.id GROUP BY ALL")
def q71(t):
    return _graph(t).query(t.spark, "WITH e AS (SELECT src, relationship FROM edges) SELECT v.database, e.relationship, count(*) AS n FROM e JOIN vertices v ON e.src = v.id GROUP BY v.database, e.relationship")


@query("q72_induced_edges", "SELECT DISTINCT src, dst, relationship FROM {links} WHERE src IN (SELECT id FROM {catalog} WHERE database = 'core') AND dst IN (SELECT id FROM {catalog} WHERE database = 'core')")
def q72(t):
    from graphloom.operators.hints import induced_edges

    return induced_edges(t.catalog.where("database = 'core'").select("id"), t.links).select("src", "dst", "relationship")


@query("q73_endpoint_vertices", "SELECT x.id, coalesce(c.label, 'unknown') AS label, c.name FROM (SELECT src AS id FROM {links} UNION SELECT dst FROM {links}) x LEFT JOIN (SELECT * FROM {catalog} WHERE label = 'Table') c ON c.id = x.id")
def q73(t):
    from graphloom.operators.hints import endpoint_vertices

    return endpoint_vertices(t.links, t.catalog.where("label = 'Table'"), None).select("id", "label", "name")


@query("q74_concepts_from_columns", "SELECT database || '__concept__' || col AS id, database, string_agg(DISTINCT name, ',' ORDER BY name) AS source_tables FROM (SELECT database, name, unnest(string_split(columns_csv, ',')) AS col FROM {catalog} WHERE label = 'Table') x GROUP BY database, col HAVING count(DISTINCT name) >= 2")
def q74(t):
    from graphloom.operators.builder import concept_nodes

    tables = t.catalog.where("label = 'Table'").select("database", F.col("name").alias("table_name"), _listed("columns_csv").alias("columns"))
    return concept_nodes(tables).select("id", "database", F.array_join("source_tables", ",").alias("source_tables"))


# -- searches that read an index


@query("q118_trigram_search", "SELECT p_partkey, p_name FROM {part} WHERE contains(lower(p_name), 'd widg')")
def q118(t):
    """Part names with a text in them: only the postings of its trigrams, and the parts that have all of them, are read."""
    index = TrigramIndex.build(t.part, f"{shared_dir(t.spark).rstrip('/')}/grams-{uuid.uuid4().hex}", ["p_name"], "p_partkey")
    return index.narrowed(t.part, ["D Widg"], id_col="p_partkey").where(F.contains(F.lower("p_name"), F.lit("d widg"))).select("p_partkey", "p_name")


@query("q119_indexed_columns", "SELECT id, database, name FROM {catalog} WHERE contains(CASE WHEN label = 'Table' THEN columns_csv ELSE key_columns_csv END, 'orderkey_1')")
def q119(t):
    g = _stored(t).indexed(f"{shared_dir(t.spark).rstrip('/')}/grams-{uuid.uuid4().hex}")
    return g.find_columns("ORDERKEY_1").select("id", "database", "name")
