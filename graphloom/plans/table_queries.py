"""Sampling, profiles, coercion, upserts and set operations on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import safe_date, safe_float, safe_int
from graphloom.operators.profile import QUARTILES, RANK_ERROR, describe, top_values, wide_union
from graphloom.operators.sqlguard import Databases
from graphloom.operators.synth import numbered
from graphloom.plans.registry import query
from graphloom.sources import catalog, ingest, store
from graphloom.streaming import windowed_counts


@query("q52_sample", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} ORDER BY o_orderkey LIMIT 10")
def q52(t):
    dbs = Databases(t.spark, {"core": {"orders_sample": t.orders.orderBy("o_orderkey")}})
    return dbs.sample("core", "orders_sample", ["o_orderkey", "o_custkey", "o_orderpriority"])


def _counts(c: str) -> str:
    return f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS LAST) AS rn FROM {{lineitem}} GROUP BY {c}"


@query("q53_profile_value_counts", f"SELECT column_name, value, n FROM ({' UNION ALL '.join(map(_counts, ('l_returnflag', 'l_linestatus')))}) x WHERE rn <= 10")
def q53(t):
    return top_values(t.lineitem, ["l_returnflag", "l_linestatus"]).select("column_name", "value", "n")


@query(
    "q54_coerce",
    r"""WITH x AS (SELECT event_id, CASE WHEN regexp_full_match(trim(raw_number), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(trim(raw_number) AS DOUBLE) END AS d, TRY_CAST(raw_date AS DATE) AS as_date FROM {raw})
    SELECT event_id, trunc(d)::BIGINT AS as_int, d AS as_float, as_date::VARCHAR AS as_date FROM x""",
)
def q54(t):
    return t.raw.select("event_id", safe_int(F.col("raw_number")).cast("long").alias("as_int"), safe_float(F.col("raw_number")).alias("as_float"), safe_date(F.col("raw_date")).cast("string").alias("as_date"))


@query("q55_fill_names", "WITH b AS (SELECT iga, row_number() OVER (ORDER BY iga) AS rn FROM {blank_names} WHERE trim(name) = '') SELECT n.iga, CASE WHEN trim(n.name) = '' THEN 'Person ' || b.rn ELSE n.name END AS name FROM {blank_names} n LEFT JOIN b ON n.iga = b.iga")
def q55(t):
    people = numbered(t.blank_names.select("iga"), "iga").select(F.col("rn").alias("n"), F.concat(F.lit("Person "), F.col("rn").cast("string")).alias("name"))
    return ingest.fill_names(t.blank_names, people).select("iga", "name")


@query("q56_purge_partition", "SELECT id, database, name FROM {catalog} WHERE database <> 'stream'")
def q56(t):
    from graphloom.operators.graph import PropertyGraph

    return store.purge(PropertyGraph(t.catalog, t.links), "stream").vertices.select("id", "database", "name")


@query("q57_upsert_policy", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN 'new ' || n_name ELSE n_name END AS content FROM {nation} UNION ALL SELECT r_regionkey + 100, r_name FROM {region}")
def q57(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"))
    new = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("new "), F.col("n_name")).alias("content")).unionByName(t.region.select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("content")))
    return store.upsert(old, new, update=("content",))


@query("q58_semi_anti_catalog_filter", "SELECT o_orderpriority AS kind, 'kept' AS side, count(*) AS n FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000) GROUP BY 1 UNION ALL SELECT o_orderpriority, 'removed', count(*) FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000) GROUP BY 1")
def q58(t):
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    kept, removed = catalog.keep_known(t.orders, rich, "o_custkey")
    count = lambda df, side: df.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n")).select("kind", F.lit(side).alias("side"), "n")
    return count(kept, "kept").unionByName(count(removed, "removed"))


@query("q59_wide_union", "SELECT 'region' AS table_name, r_regionkey, r_name, NULL::INT AS n_nationkey, NULL::VARCHAR AS n_name FROM {region} UNION ALL SELECT 'nation', NULL, NULL, n_nationkey, n_name FROM {nation}")
def q59(t):
    a = t.region.select(F.lit("region").alias("table_name"), "r_regionkey", "r_name")
    return wide_union([a, t.nation.select(F.lit("nation").alias("table_name"), "n_nationkey", "n_name")])


@query("q67_guarded_sql", "SELECT c_mktsegment, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1")
def q67(t):
    dbs = Databases(t.spark, {"core": {"gl_orders": t.orders, "gl_customer": t.customer}})
    return dbs.execute("core", "WITH o AS (SELECT * FROM gl_orders) SELECT c_mktsegment, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM o JOIN gl_customer ON o_custkey = c_custkey GROUP BY 1")


@query("q68_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
def q68(t):
    return windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("start", "event_type", "n")


@query(
    "q69_relationship_text",
    r"""SELECT DISTINCT src_table, trim(regexp_extract(part, '^([^(]*)\(', 1)) AS dst_table, replace(regexp_extract(part, '\(([^)]*)\)', 1), ' ', '') AS dst_columns
    FROM (SELECT n_name AS src_table, unnest(regexp_extract_all('Region(r_regionkey), ' || n_name || '(a, b)', '([A-Za-z_][A-Za-z0-9_ ]*?)\s*\(([^)]*)\)')) AS part FROM {nation}) x""",
)
def q69(t):
    from graphloom.operators.builder import relationship_edges

    rows = t.nation.select(F.col("n_name").alias("table_name"), F.concat(F.lit("Region(r_regionkey), "), F.col("n_name"), F.lit("(a, b)")).alias("relationship_text"))
    return relationship_edges(rows).select("src_table", "dst_table", F.array_join("dst_columns", ",").alias("dst_columns"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


def _described(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most,
      true AS lower_fits, true AS median_fits, true AS upper_fits FROM {{lineitem}}"""


@query("q75_describe", " UNION ALL ".join(map(_described, _NUMBERS)))
def q75(t):
    """A profile in one pass; the sketches' quartiles are held against the rows: their ranks are within the error that is stated."""
    told = describe(t.lineitem, list(_NUMBERS))
    each = t.lineitem.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in _NUMBERS])).alias("e")).select("e.*")
    names = ("lower", "median", "upper")
    ranks = each.join(F.broadcast(told.select("column_name", *names)), "column_name").groupBy("column_name").agg(
        *[f(F.avg((F.col("x") < F.col(c)).cast("int")), F.avg((F.col("x") <= F.col(c)).cast("int")), q).alias(f"{c}_fits") for c, q, f in ((c, q, lambda below, upto, q: (below <= q + RANK_ERROR) & (upto >= q - RANK_ERROR)) for c, q in zip(names, QUARTILES, strict=True))]
    )
    return told.drop(*names).join(ranks, "column_name").withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4)})
