"""Join keys from table metadata, and scored keyword search over a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import contains_ci
from graphloom.operators.graph import PropertyGraph

# What marks an identifier, a name and a measure.
ID_PATTERNS = (
    "iga", "employeeid", "empid", "employee_id", "emp_id", "userid", "user_id",
    "personid", "person_id", "staffid", "staff_id", "employeenumber", "employee_number",
    "uniqueid", "recordid", "crewid", "crew_id", "memberid",
)
NAME_FIELDS = ("name", "fullname", "employeename", "username")
METRIC_WORDS = ("score", "rating", "bmi", "count", "total", "amount")


def column_class(clean: Column, primary_key: Column) -> Column:
    """identifier, primary_key, name_field, metric or data.

    A table with a primary key has no name fields or metrics: its other
    columns are data.
    """
    low = F.regexp_replace(F.lower(clean), r"[\[\] _]", "")
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    keyed = F.coalesce(primary_key, F.lit("")) != ""
    return (
        F.when(any_of(ID_PATTERNS) | low.endswith("id"), "identifier")
        .when(keyed & (F.lower(clean) == F.lower(primary_key)), "primary_key")
        .when(keyed, "data")
        .when(low.isin(*NAME_FIELDS), "name_field")
        .when(any_of(METRIC_WORDS), "metric")
        .otherwise("data")
    )


def shared_columns(tables: DataFrame) -> DataFrame:
    """(column, tables, column_type, confidence, first_seen) of columns that two or more tables share.

    ``tables`` has (ord, table_name, columns array<string>, primary_key); the
    names must be equal but for brackets.  A column's class is that in the
    first table.  Identifiers are HIGH, others LOW.
    """
    each = tables.select("ord", "table_name", "primary_key", F.posexplode("columns").alias("pos", "raw"))
    each = each.withColumn("column", F.regexp_replace("raw", r"[\[\]]", "")).where("column <> ''")
    each = each.withColumn("class", column_class(F.col("column"), F.col("primary_key")))
    out = each.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("ord", "table_name"))).alias("found"),
        F.min(F.struct("ord", "pos", "class")).alias("first"),
        F.count("*").alias("n"),
    )
    out = out.where("n >= 2").select("column", F.transform("found", lambda x: x["table_name"]).alias("tables"), F.col("first.class").alias("column_type"), (F.col("first.ord") * 100_000 + F.col("first.pos")).alias("first_seen"))
    return out.withColumn("confidence", F.when(F.col("column_type").isin("identifier", "primary_key"), "HIGH").otherwise("LOW")).orderBy(F.when(F.col("confidence") == "HIGH", 0).otherwise(1), "first_seen")


def find_join_keys(graph: PropertyGraph, tables: list[str]) -> dict:
    """Recommendations, the best join column and the edges between the tables; the tables are few, so rows are collected."""
    if len(tables) < 2:
        return {"error": "give at least two tables"}
    spark = graph.vertices.sparkSession
    wanted = spark.createDataFrame(list(enumerate(tables)), "ord int, wanted string")
    primary = F.element_at("primary_keys", 1) if "primary_keys" in graph.vertices.columns else F.lit(None).cast("string")
    found = graph.vertices.where("label = 'Table'").join(wanted, F.col("name") == F.col("wanted")).select("ord", "id", F.col("name").alias("table_name"), "columns", primary.alias("primary_key"))
    recommended = [r.asDict() for r in shared_columns(found).collect()]
    ids = found.select("id")
    links = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "relationship", "dst").collect()
    best = next((r["column"] for r in recommended if r["confidence"] == "HIGH"), None)
    out = {"tables_analyzed": tables, "join_recommendations": recommended, "best_join_column": best, "explicit_relationships": [r.asDict() for r in links]}
    return out if best else out | {"warning": "no shared identifier"}


def semantic_search(graph: PropertyGraph, keywords: list[str], top: int = 15, per_keyword: int | None = 20) -> DataFrame:
    """Names by relevance: over all keywords 3 for a hit in the name, 2 in the description and 1 in the label.

    Candidates are the first ``per_keyword`` hits of each keyword (None: all).
    """
    hit = lambda c: reduce(lambda a, b: a + b, [F.when(contains_ci(F.col(c), k), 1).otherwise(0) for k in keywords])
    if per_keyword is None:
        any_ = reduce(lambda a, b: a | b, [contains_ci(F.col(c), k) for k in keywords for c in ("name", "display_name", "description")])
        found = graph.narrowed(keywords, ["name", "display_name", "description"]).where(any_)
    else:
        found = reduce(DataFrame.unionByName, [graph.search(k, per_keyword).drop("name_hit") for k in keywords])
    scored = found.withColumn("relevance_score", (hit("description") * 2 + hit("label") + hit("name") * 3).cast("long"))
    one = scored.groupBy("name").agg(F.min(F.struct("database", "id", "label", "description", "relevance_score")).alias("r")).select("name", "r.*")
    return one.orderBy(F.desc("relevance_score"), "name").limit(top)
