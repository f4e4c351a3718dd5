"""Domain tables as projections of the test tables.

Each view is one SQL text that Spark and DuckDB both read: braces around a
name mark a test table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # -- employees
    "hr": """SELECT c.c_custkey AS iga, c.c_name AS name, n.n_name AS base, c.c_mktsegment AS designation
             FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "perf": """SELECT o_custkey AS iga, 15 + CAST(o_custkey % 320 AS DOUBLE) / 20 AS bmi, count(*) AS appreciation_letters,
                      CASE WHEN count(*) % 7 = 0 THEN '2.0' ELSE CAST(count(*) % 5 AS STRING) END AS caution_letters,
                      CAST(count(*) % 6 AS STRING) AS coaching_sessions,
                      CASE WHEN o_custkey % 4 = 0 THEN '6e Clap' WHEN o_custkey % 4 = 1 THEN ' None ' WHEN o_custkey % 4 = 2 THEN max(o_orderpriority) END AS recognition
               FROM {orders} GROUP BY o_custkey""",
    "leave": """SELECT iga, status, active, lwd, no_of_leaves FROM (
                  SELECT o_custkey AS iga,
                         CASE o_orderstatus WHEN 'F' THEN 'Released' WHEN 'O' THEN 'Active' END AS status,
                         CASE WHEN o_orderkey % 4 = 0 THEN 'N' WHEN o_orderkey % 4 < 3 THEN 'Y' END AS active,
                         CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderdate AS DATE) END AS lwd,
                         CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 13 END AS no_of_leaves,
                         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
                  FROM {orders} WHERE o_orderpriority = '1-URGENT') x WHERE rn = 1""",
    "nps": """SELECT iga, nps_score FROM (
                SELECT user_id AS iga, event_id % 11 AS nps_score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}) x WHERE rn = 1""",
    # -- loyalty
    "spend": "SELECT o_custkey AS ffn_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, count(*) AS bookings FROM {orders} GROUP BY o_custkey",
    "member_tier": """SELECT ffn_id, spend AS qualifying_spend, bookings AS qualifying_flights,
                             CASE WHEN spend >= 3500000 AND bookings >= 12 THEN 'top' WHEN spend >= 2000000 AND bookings >= 8 THEN 'middle' ELSE 'entry' END AS tier_name FROM {spend}""",
    # the tiers that members have, and one that nobody has
    "tier": """SELECT tier_name, CASE tier_name WHEN 'top' THEN 3 WHEN 'middle' THEN 2 ELSE 1 END AS tier_rank FROM (SELECT DISTINCT tier_name FROM {member_tier}) x
               UNION ALL SELECT DISTINCT 'retired', 0 FROM {orders}""",
    "member": """SELECT c.c_custkey AS ffn_id, c.c_name AS full_name, c.c_mktsegment AS customer_type,
                        CASE WHEN s.bookings >= 10 THEN 'HIGH' ELSE 'LOW' END || '_FREQ_' || CASE WHEN s.spend >= 2500000 THEN 'HIGH' ELSE 'LOW' END || '_SPEND' AS spending_segment,
                        CASE WHEN s.bookings <= 1 THEN 'ONE_TIME' WHEN s.bookings <= 4 THEN 'ANNUAL' ELSE 'FREQUENT' END AS flyer_frequency
                 FROM {customer} c JOIN {spend} s ON c.c_custkey = s.ffn_id""",
    "booking": "SELECT o_orderkey AS booking_id, o_custkey AS ffn_id, CAST(o_orderdate AS DATE) AS booking_date, o_orderpriority AS fare_type, o_orderstatus AS booking_status, o_totalprice AS total_fare FROM {orders}",
    "route": """SELECT cn.n_name || '_' || sn.n_name AS route_id, cn.n_name AS origin, sn.n_name AS destination FROM {nation} cn CROSS JOIN {nation} sn""",
    # the key of a lineitem is all of these together
    "leg": """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING),
                               CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS segment_id,
                     l_orderkey AS booking_id, l_partkey AS addon_id, l_suppkey, CAST(l_shipdate AS DATE) AS flight_date FROM {lineitem}""",
    "segment": """SELECT l.segment_id, l.booking_id, o.o_custkey AS ffn_id, l.addon_id, l.flight_date, cn.n_name || '_' || sn.n_name AS route_id, cn.n_name AS origin, sn.n_name AS destination
                  FROM {leg} l JOIN {orders} o ON l.booking_id = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
                  JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey""",
    "segment_addon": "SELECT segment_id, addon_id FROM {leg}",
    "addon": "SELECT p_partkey AS addon_id, p_type AS addon_type, p_name AS addon_name, p_brand AS category, p_retailprice AS approx_price FROM {part}",
    "fare_type": "SELECT DISTINCT o_orderpriority AS fare_name FROM {orders}",
    "partner": "SELECT s.s_suppkey AS partner_id, s.s_name AS partner_name, n.n_name AS category FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey",
    "partner_txn": """SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING), CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING)) AS transaction_id,
                             o.o_custkey AS ffn_id, l.l_suppkey AS partner_id, CAST(l.l_shipdate AS DATE) AS activity_date, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS spend_amount
                      FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    # -- the metadata graph: id, label, database, name, display name, description, columns, primary key, source tables, key columns
    # tables: regions, nations, customers and suppliers; concepts: parts, of which three have a name in three databases
    "part_db": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'stream' ELSE 'corpus' END AS db,
                         CASE p_partkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'stream' ELSE 'corpus' END || '__c' || CAST(p_partkey AS STRING) AS id FROM {part}""",
    "supplier_db": """SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'stream' ELSE 'corpus' END AS db,
                             CASE s_suppkey % 2 WHEN 0 THEN 'stream' ELSE 'corpus' END || '__t' || CAST(s_suppkey AS STRING) AS id FROM {supplier}""",
    "catalog": """
      SELECT 'core__r' || CAST(r_regionkey AS STRING) AS id, 'Table' AS label, 'core' AS database, r_name AS name, lower(r_name) AS display_name, 'A part of the world' AS description,
             'r_regionkey,r_name,r_id' AS columns_csv, 'r_regionkey' AS primary_key, '' AS source_tables_csv, '' AS key_columns_csv FROM {region}
      UNION ALL
      SELECT 'core__n' || CAST(n_nationkey AS STRING), 'Table', 'core', n_name, 'Nation ' || CAST(n_nationkey AS STRING), 'Where buyers and sellers are',
             'n_nationkey,n_name,n_regionkey', 'n_nationkey', '', '' FROM {nation}
      UNION ALL
      SELECT 'core__t' || CAST(c_custkey AS STRING), 'Table', 'core', c_name, c_mktsegment || ' ' || CAST(c_custkey AS STRING), 'Orders of ' || lower(c_mktsegment) || ' buyers',
             'a' || CAST(c_custkey % 40 AS STRING) || '_id,b' || CAST(c_custkey % 7 AS STRING) || '_key,c_custkey,orderkey_' || CAST(c_custkey % 100 AS STRING),
             CASE WHEN c_custkey % 2 = 0 THEN 'b' || CAST(c_custkey % 7 AS STRING) || '_key' ELSE '' END, '', '' FROM {customer}
      UNION ALL
      SELECT d.id, 'Table', d.db, s.s_name, 'Seller ' || CAST(s.s_suppkey AS STRING), 'Deliveries of a seller', 's_suppkey,a' || CAST(s.s_suppkey % 40 AS STRING) || '_id,s_when', 's_suppkey', '', ''
      FROM {supplier} s JOIN {supplier_db} d ON d.s_suppkey = s.s_suppkey
      UNION ALL
      SELECT d.id, 'Concept', d.db, 'Topic ' || CAST(CAST(floor(p.p_partkey / 3) AS INT) AS STRING), p.p_type || ' ' || p.p_brand, p.p_name || ' of size ' || CAST(p.p_size AS STRING), '', '',
             coalesce(c.c_name, 'nowhere') || ',' || coalesce(s.s_name, 'nowhere'), 'a' || CAST(p.p_partkey % 40 AS STRING) || '_id,orderkey_' || CAST(p.p_partkey % 100 AS STRING)
      FROM {part} p JOIN {part_db} d ON d.p_partkey = p.p_partkey LEFT JOIN {customer} c ON c.c_custkey = p.p_partkey LEFT JOIN {supplier} s ON s.s_suppkey = p.p_partkey % 10
      UNION ALL
      SELECT 'corpus__x' || CAST(n_nationkey AS STRING), 'Concept', 'corpus', 'Lonely ' || CAST(n_nationkey AS STRING), 'Lonely', 'Linked to nothing', '', '', 'nowhere', '' FROM {nation}""",
    "links": """SELECT DISTINCT src, dst, relationship FROM (
      SELECT 'core__n' || CAST(n_nationkey AS STRING) AS src, 'core__r' || CAST(n_regionkey AS STRING) AS dst, 'HAS_FK' AS relationship FROM {nation}
      UNION ALL SELECT 'core__t' || CAST(c_custkey AS STRING), 'core__n' || CAST(c_nationkey AS STRING), 'HAS_FK' FROM {customer}
      UNION ALL SELECT d.id, 'core__n' || CAST(s.s_nationkey AS STRING), 'LOCATED_IN' FROM {supplier} s JOIN {supplier_db} d ON d.s_suppkey = s.s_suppkey
      UNION ALL SELECT id, 'core__t' || CAST(s_suppkey AS STRING), 'DONE_BY' FROM {supplier_db}
      UNION ALL SELECT id, id, 'FOLLOWS' FROM {supplier_db} WHERE s_suppkey % 4 = 0
      UNION ALL SELECT 'core__t' || CAST(o.o_custkey AS STRING), d.id, CASE WHEN l.l_orderkey % 3 = 0 THEN 'CONTAINS_CONCEPT' ELSE 'RELATES_TO' END
                FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part_db} d ON d.p_partkey = l.l_partkey WHERE l.l_linenumber = 1
      UNION ALL SELECT s.id, d.id, 'RELATES_TO' FROM {lineitem} l JOIN {supplier_db} s ON s.s_suppkey = l.l_suppkey JOIN {part_db} d ON d.p_partkey = l.l_partkey WHERE l.l_linenumber = 2
      UNION ALL SELECT a.id, b.id, 'RELATED' FROM {part_db} a JOIN {part_db} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 5 = 0
      UNION ALL SELECT a.id, b.id, 'EQUIVALENT' FROM {part_db} a JOIN {part_db} b ON b.p_partkey = a.p_partkey + 2 WHERE a.p_partkey % 7 = 0) x""",
    # the same graph, somewhat changed, for comparisons
    "links2": """SELECT src, dst, relationship FROM {links} WHERE relationship <> 'EQUIVALENT' AND src NOT LIKE 'core__n1%'
      UNION ALL SELECT 'corpus__x' || CAST(n_nationkey AS STRING), 'core__n' || CAST(n_nationkey AS STRING), 'RELATES_TO' FROM {nation}""",
    "both_ways": "SELECT src, dst, relationship, true AS outgoing FROM {links} UNION ALL SELECT dst AS src, src AS dst, relationship, false AS outgoing FROM {links} WHERE src <> dst",
    # -- the instance graph: regions, nations, customers and suppliers
    "places": """SELECT 'r' || CAST(n_regionkey AS STRING) AS src, 'n' || CAST(n_nationkey AS STRING) AS dst, 'HAS_NATION' AS relationship FROM {nation}
                 UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'HAS_CUSTOMER' FROM {customer}
                 UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING), 'HAS_SUPPLIER' FROM {supplier}""",
    # -- concepts with vectors, of two graphs
    "vec_a": "SELECT CAST(vec_id AS STRING) AS id, embedding, label FROM {embeddings} WHERE vec_id % 2 = 0",
    "vec_b": "SELECT CAST(vec_id AS STRING) AS id, embedding, label FROM {embeddings} WHERE vec_id % 2 = 1",
    # -- texts to coerce
    "raw": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN CAST(event_id % 100 AS STRING) || '.9' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN 'nan' ELSE ' 7 ' END AS raw_number,
                     CASE event_id % 4 WHEN 0 THEN '2026-02-30' WHEN 1 THEN '2026-02-28' WHEN 2 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS raw_date FROM {events}""",
    "blank_names": "SELECT c_custkey AS iga, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS name FROM {customer}",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))})


def oracle(text: str) -> str:
    """SQL for DuckDB: the views that a text names come first, each once."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in _NAME.findall(t):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: _NAME.sub(r"\1", t)
    views = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[14:]}"
    return f"WITH {views},\n{body[4:]}" if body.upper().startswith("WITH") else f"WITH {views}\n{body}"
