"""Files and stores: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.plans.graph_queries import _graph, _stored
from graphloom.plans.registry import Tables, query
from graphloom.scratch import shared_dir
from graphloom.sources import catalog, store


def _path(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("q120_table_filter", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey % 3 = 0")
def q120(t):
    """A filter file with comments, dashes and blank lines keeps the tables that it names."""
    k = F.col("c_custkey") % 4
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_name")).when(k == 0, F.concat(F.lit("# "), "c_name")).when(k == 1, F.concat(F.lit("- "), "c_name")).otherwise("")
    path = _path(t, "filter")
    t.customer.select(line).write.text(path)
    named = t.customer.withColumn("table_name", F.col("c_name"))
    return catalog.keep_known(named, catalog.table_filter(t.spark, path))[0].select("c_custkey", "c_name")


@query("q121_graph_as_json", """SELECT 'node' AS kind, id AS a, label AS b, description AS c FROM {catalog} UNION ALL SELECT 'edge', src, relationship, dst FROM {links}""")
def q121(t):
    path = _path(t, "graph-json")
    store.write_graph(_stored(t), path)
    nodes, edges = t.spark.read.json(f"{path}/nodes"), t.spark.read.json(f"{path}/edges")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("description").alias("c")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("relationship").alias("b"), F.col("dst").alias("c")))


@query("q122_store_and_purge", "SELECT database, label, count(*) AS n FROM {catalog} WHERE database <> 'stream' GROUP BY ALL")
def q122(t):
    """The whole graph is stored by one save, and a database purged from it; the backend is asked for by name."""
    kept = store.GraphStore(t.spark, _path(t, "store"))
    kept.save(_stored(t), whole=True)
    kept.purge("stream")
    return store.get_graph_db("spark", kept).vertices.groupBy("database", "label").agg(F.count("*").alias("n"))


@query("q123_encoded_csv", "SELECT p_partkey, p_name || ' é ß' AS p_name FROM {part}")
def q123(t):
    path = _path(t, "latin")
    t.part.select("p_partkey", F.concat("p_name", F.lit(" é ß")).alias("p_name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return catalog.read_csv(t.spark, path, encoding="ISO-8859-1").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@query("q124_pushed_batches", "SELECT id, label, database FROM {catalog} WHERE database <> 'core' UNION ALL SELECT DISTINCT 'corpus__new', 'Table', 'corpus' FROM {region}")
def q124(t):
    """A database at a time is pushed as a batch, one batch twice, and then a vertex of another stream."""
    kept, g = store.GraphStore(t.spark, _path(t, "pushed")), _stored(t)
    none = g.edges.limit(0)
    for number, db in enumerate(("stream", "corpus", "corpus")):
        store.push(kept, g.vertices.where(F.col("database") == db), none, ("catalog", min(number, 1)))
    new = g.vertices.where("database = 'corpus'").limit(1).withColumns({"id": F.lit("corpus__new"), "label": F.lit("Table")})
    store.push(kept, new, none, ("other", 0))
    return kept.load().vertices.select("id", "label", "database")


@query("q125_cli_verbs", "SELECT label AS name, count(*) AS n FROM {catalog} GROUP BY label UNION ALL SELECT relationship, count(*) FROM {links} GROUP BY relationship UNION ALL SELECT 'edges', count(*) FROM {links}")
def q125(t):
    """The command line's ``schema`` verb."""
    from graphloom import cli

    rows = cli.run(_graph(t), "schema", [])
    return t.spark.createDataFrame([(r["name"], r["n"]) for r in rows], "name string, n long")


@query("q126_pruned_pairs", """WITH d AS (SELECT a.id AS left_id, b.id AS right_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM {vec_a} a, {vec_b} b)
    SELECT left_id, right_id, round(s, 4) AS similarity FROM d WHERE s >= 0.35""")
def q126(t):
    """Pairs above a threshold, of blocks that may hold one."""
    from graphloom.operators.unify import similarities

    return similarities(t.vec_a, t.vec_b, at_least=0.35).select("left_id", "right_id", F.round("similarity", 4).alias("similarity"))


@query("q127_private_databases", "SELECT 'orders' AS database, count(*) AS n FROM {orders} UNION ALL SELECT 'parts', count(*) FROM {part} UNION ALL SELECT 'nations', count(*) FROM {nation}")
def q127(t):
    """Three databases with a table of the same name each."""
    from functools import reduce

    from graphloom.operators.sqlguard import Databases

    dbs = Databases(t.spark, {"orders": {"things": t.orders}, "parts": {"things": t.part}, "nations": {"things": t.nation}})
    parts = [dbs.execute(db, "SELECT :db AS database, count(*) AS n FROM things", None, {"db": db}) for db in ("orders", "parts", "nations")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("q128_static_rows", "SELECT n_name AS code, r_name AS city, NULL AS country, n_nationkey % 2 = 0 AS is_international FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
def q128(t):
    """A static table of a loader's rows; what they lack is null."""
    from graphloom.sources.loyalty import static_table

    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).collect()
    return static_table(t.spark, "airport", [{"code": r.n_name, "city": r.r_name, "is_international": r.n_nationkey % 2 == 0} for r in rows])
