"""What the guard lets through, what it refuses, and that databases stay apart."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from graphloom.operators import agent, sqlguard
from graphloom.operators.graph import PropertyGraph

WIDE = ", ".join(f"id AS c{i}" for i in range(60))
CALL = "reflect('java.lang.System', 'getProperty', 'user.home')"

ATTACKS = [
    # scripts, at any depth
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM things",
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'touch {made}' AS (x STRING) FROM things) y",
    "FROM things SELECT TRANSFORM(id) USING 'touch {made}' AS (x)",
    "FROM things MAP id USING 'touch {made}' AS x",
    "FROM things REDUCE id USING 'touch {made}' AS x",
    "WITH a AS (SELECT TRANSFORM(id) USING 'touch {made}' AS (x) FROM things) SELECT * FROM a",
    "SELECT id FROM things WHERE id IN (SELECT TRANSFORM(id) USING 'touch {made}' AS (x BIGINT) FROM things)",
    "SELECT (SELECT max(x) FROM (SELECT TRANSFORM(id) USING 'touch {made}' AS (x) FROM things)) AS m FROM things",
    "SELECT 1 UNION ALL SELECT x FROM (SELECT TRANSFORM(id) USING 'touch {made}' AS (x) FROM things)",
    "SELECT * FROM things t, LATERAL (SELECT TRANSFORM(t.id) USING 'touch {made}' AS (x)) l",
    # methods of the JVM, beyond what a printed plan shows
    f"SELECT {CALL}",
    f"SELECT {WIDE}, {CALL} AS x FROM things",
    f"SELECT {WIDE}, upper({CALL}) AS x FROM things",
    f"SELECT id FROM things WHERE id > 0 AND {CALL} <> ''",
    f"SELECT count(*) FROM things GROUP BY {CALL}",
    f"SELECT id FROM things ORDER BY {CALL}",
    f"SELECT count(*) FROM things HAVING max({CALL}) <> ''",
    f"SELECT transform(array(1), x -> {CALL}) FROM things",
    f"SELECT sum(id) OVER (PARTITION BY {CALL}) FROM things",
    f"SELECT * FROM things a JOIN things b ON a.id = b.id AND {CALL} <> ''",
    f"SELECT * FROM VALUES ({CALL}) AS v(a)",
    f"SELECT CASE WHEN id = 1 THEN {CALL} END FROM things",
    "SELECT java_method('java.lang.System', 'exit', 1) FROM things",
    "SELECT try_reflect('java.lang.System', 'getenv', 'PATH') FROM things",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') FROM things",
    "SELECT REFLECT('java.lang.System', 'getProperty', 'user.home') FROM things",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') FROM things",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') FROM things",
    "SELECT * FROM things LATERAL VIEW reflect('java.lang.System', 'getProperty', 'user.home') v AS x",
    # other relations
    "SELECT * FROM parquet.`{data}/nation.parquet`",
    "SELECT * FROM text.`/etc/passwd`",
    "SELECT * FROM csv.`file:///etc/passwd`",
    "SELECT * FROM secret",
    "SELECT * FROM default.things",
    "SELECT * FROM spark_catalog.default.secret",
    "SELECT * FROM global_temp.secret",
    "SELECT * FROM IDENTIFIER('sec' || 'ret')",
    "TABLE secret",
    "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret) a, secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT id FROM things WHERE EXISTS (SELECT 1 FROM secret)",
    "SELECT * FROM STREAM things",
    "SELECT * FROM things VERSION AS OF 1",
    # functions in FROM, hints, names of the machine
    "SELECT * FROM read_files('/etc')",
    "SELECT * FROM python_worker_logs()",
    "SELECT /*+ BROADCAST(things) */ * FROM things",
    "SELECT input_file_name() FROM things",
    "SELECT from_protobuf(cast('' AS BINARY), 'M', '/etc/passwd') FROM things",
    "SELECT from_xml('<a/>', 'a INT', map('rowValidationXSDPath', '/etc/passwd')) FROM things",
    "SELECT '${env:PATH}' AS x",
    "SELECT '${system:user.home}' AS x",
    "SELECT own_udf(id) FROM things",
    # commands
    "INSERT INTO things VALUES (1)",
    "INSERT OVERWRITE DIRECTORY '{made}' USING parquet SELECT 1",
    "FROM things INSERT OVERWRITE DIRECTORY '{made}' SELECT id",
    "CREATE TABLE x AS SELECT 1",
    "CREATE TEMPORARY VIEW v AS SELECT 1",
    "WITH a AS (SELECT 1) INSERT INTO things SELECT * FROM a",
    "MERGE INTO things t USING things s ON t.id = s.id WHEN MATCHED THEN DELETE",
    "EXPLAIN SELECT 1",
    "CACHE TABLE things",
    "ADD JAR '/tmp/x.jar'",
    "SET spark.sql.runSQLOnFiles = true",
    "BEGIN SELECT 1; END",
    "EXECUTE IMMEDIATE 'DROP TABLE things'",
    "DECLARE VARIABLE x INT DEFAULT 1",
    "DESCRIBE things",
]

QUERIES = [
    "SELECT id + 1 AS a, -id AS b, id % 2 AS c, id & 1 AS d, id || 'x' AS e, id / 2 AS f, id DIV 2 AS g FROM things t WHERE NOT (id > 3 AND id <= 8 OR id IN (1, 2)) AND id IS NOT NULL AND id <=> id",
    "WITH a AS (SELECT id FROM things), b AS (SELECT * FROM a WHERE id > (SELECT avg(id) FROM a)) SELECT * FROM b UNION ALL SELECT id FROM a INTERSECT SELECT id FROM Things EXCEPT SELECT 1",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "WITH a AS (WITH b AS (SELECT 1 AS x) SELECT * FROM b) SELECT * FROM a, things WHERE a.x = things.id",
    "SELECT row_number() OVER (PARTITION BY id % 3 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, sum(id) OVER w AS s FROM things WINDOW w AS (ORDER BY id RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING)",
    "SELECT transform(array(id, 2), x -> x + 1) AS a, filter(array(1, 2), (x, i) -> i > 0) AS b, map('k', id)['k'] AS c, named_struct('f', id).f AS d, struct(id) AS e FROM things",
    "SELECT id, y, z FROM things LATERAL VIEW explode(array(1, 2)) v AS y LATERAL VIEW OUTER posexplode(array('a')) p AS z, q",
    "SELECT id % 2 AS k, count(DISTINCT id) FILTER (WHERE id > 1) AS n, any_value(id) AS v, first(id) AS f, percentile_cont(0.5) WITHIN GROUP (ORDER BY id) AS p FROM things GROUP BY ROLLUP (id % 2) HAVING count(*) > 0 ORDER BY k NULLS LAST LIMIT 5 OFFSET 0",
    "SELECT a.id, l.y FROM things a JOIN others b USING (id) LEFT ANTI JOIN (SELECT 99 AS id) c ON a.id = c.id, LATERAL (SELECT a.id AS y) l",
    "SELECT /*+ MERGE(others) */ things.id FROM things NATURAL JOIN others",
    "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS v(n, s)",
    "SELECT * FROM range(5) r",
    "SELECT * FROM (SELECT id, id % 2 AS k FROM things) PIVOT (sum(id) FOR k IN (0 AS even, 1 AS odd))",
    "SELECT * FROM (SELECT id AS a, id AS b FROM things) UNPIVOT (v FOR n IN (a, b))",
    "SELECT CASE id WHEN 1 THEN 'one' ELSE CAST(id AS STRING) END AS t, try_cast('x' AS INT) AS n, id::INT AS i, DATE '2026-01-01' + INTERVAL 1 DAY AS d, extract(YEAR FROM current_date()) AS y, trim(BOTH 'x' FROM 'xax') AS s, substring('abc' FROM 2 FOR 1) AS u, position('b' IN 'abc') AS p FROM things",
    "SELECT id FROM things WHERE CAST(id AS STRING) LIKE '1%' OR CAST(id AS STRING) ILIKE ANY ('2%', '3%') OR CAST(id AS STRING) RLIKE '^4' AND id BETWEEN 1 AND 9",
    "SELECT * EXCEPT (id) FROM (SELECT id, 1 AS x FROM things)",
    "TABLE things",
    "VALUES (1), (2)",
    "SELECT updated_at FROM (SELECT id AS updated_at FROM things) WHERE updated_at <> 1",
    "SELECT '${' || 'x' AS plain FROM things".replace("${", "$"),
    "FROM things SELECT max(id) AS m",
    "SELECT id % 2, count(*) AS n FROM things GROUP BY 1 ORDER BY 2 DESC",
    f"SELECT {WIDE} FROM things",
]


@pytest.fixture(scope="module")
def tables(spark):
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).createOrReplaceGlobalTempView("secret")
    spark.udf.register("own_udf", lambda x: x)
    yield {"things": spark.range(12), "others": spark.range(5)}
    spark.catalog.dropTempView("secret")
    spark.catalog.dropGlobalTempView("secret")


@pytest.mark.parametrize("k", range(len(ATTACKS)))
def test_refused(spark, tables, data, tmp_path, k):
    made = tmp_path / "made"
    text = ATTACKS[k].replace("{made}", str(made)).replace("{data}", data)
    with pytest.raises(sqlguard.Refused):
        sqlguard.run_on(spark, tables, text).collect()
    assert not made.exists() and spark.table("secret").count() == 3


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_runs(spark, tables, k):
    own = sqlguard.private_session(spark, tables)
    got = sqlguard.run_on(spark, tables, QUERIES[k])
    assert sorted(map(str, got.collect())) == sorted(map(str, own.sql(QUERIES[k]).collect()))
    # the rows are a table of the caller's session
    assert got.withColumn("one", got[f"`{got.columns[0]}`"]).count() == got.count()


def test_private_sessions_take_the_settings(spark, tables):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert sqlguard.private_session(spark, {}).conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"
    with pytest.raises(Exception, match="secret"):
        sqlguard.private_session(spark, tables).sql("SELECT * FROM secret").collect()


def test_parameters_and_nested_views(spark, tables):
    inner = sqlguard.run_on(spark, tables, "SELECT id FROM things WHERE id > :least", {"least": 7})
    assert sqlguard.run_on(spark, {"things": inner, "again": inner}, "SELECT count(*) AS n FROM things JOIN again USING (id)").first().n == 4


def test_join_columns(spark):
    wide = " AND ".join(f"a.k{i} = b.k{i}" for i in range(40))
    assert sqlguard.joins(spark, f"SELECT 1 FROM t a JOIN u b ON {wide} AND a.IGA = b.iga JOIN v USING (code) WHERE a.name = 'x'") == [{"code"}, {f"k{i}" for i in range(40)} | {"iga"}]
    t = sqlguard.Tracker(keys_asked=True, join_column="iga")
    assert t.check(spark, "d", f"SELECT 1 FROM t a JOIN u b ON {wide} AND a.iga = b.iga") is None


def test_threads_see_their_own_database(spark):
    """Four threads, four databases whose tables have the same names, and 1,000 queries in all (250 with QUICK)."""
    n = 62 if os.environ.get("QUICK") else 250
    own = {f"d{k}": {"things": spark.createDataFrame([(f"d{k}", i) for i in range(k + 1)], "db string, i int")} for k in range(4)}
    dbs = sqlguard.Databases(spark, own)

    def ask(k: int) -> list:
        out = []
        for j in range(n):
            at = (k + j) % 4
            # analysing is where names are bound; every tenth query runs
            df = dbs.execute(f"d{at}", "SELECT max(db) AS db, count(*) AS n FROM things")
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            row = df.first() if j % 10 == 0 else None
            out.append((at, plan, row))
        return out

    with ThreadPoolExecutor(4) as pool:
        results = [x for part in pool.map(ask, range(4)) for x in part]
    assert len(results) == 4 * n
    ids = {k: own[f"d{k}"]["things"]._jdf.queryExecution().analyzed().output().head().exprId().id() for k in range(4)}
    for at, plan, row in results:
        assert f"db#{ids[at]}" in plan
        assert row is None or (row.db, row.n) == (f"d{at}", at + 1)


def test_databases_follow_their_tables(spark):
    dbs = sqlguard.Databases(spark, {"a": {"t": spark.range(3)}})
    count = lambda: dbs.execute("a", "SELECT count(*) AS n FROM t").first().n
    assert count() == 3
    dbs.databases["a"]["t"] = spark.range(5)
    assert count() == 5
    cut = dbs.execute_query("a", "SELECT id FROM t", 2)
    assert cut["truncated"] and cut["row_count"] == 2 and not dbs.execute_query("a", "SELECT id FROM t", 5)["truncated"]


def test_cut_results_say_so(spark, monkeypatch):
    monkeypatch.setattr(agent, "MOST_ROWS", 3)
    v = spark.createDataFrame([(f"c{i}", "Concept", "core", f"c{i}", "", ["x"], ["y"]) for i in range(5)], "id string, label string, database string, name string, description string, source_tables array<string>, key_columns array<string>")
    tools = agent.Tools(PropertyGraph(v, spark.createDataFrame([], "src string, dst string, relationship string")))
    seen = []
    moves = iter([{"calls": [("list_concepts", {}), ("schema", {})]}, {"answer": "done"}])

    def planner(messages):
        seen.append([m["content"] for m in messages])
        return next(moves)

    events = list(agent.loop(tools, planner, "q"))
    assert events[0]["truncated"] and len(events[0]["result"]) == 3 and not events[1]["truncated"]
    assert '"truncated": true' in seen[1][1] and "truncated" not in seen[1][2]
