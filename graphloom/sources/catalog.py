"""Schema catalogs: CSV files of tables and columns, normalised to two tables.

``catalog_columns``: database, table_name, column_name, ordinal, data_type,
description.  ``catalog_tables``: database, table_name, description, columns,
primary_keys, row_count, relationship_text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import safe_int, safe_text


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, all text; a byte order mark and blanks around header names are taken off."""
    df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def read_csv_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The CSV, or None if there is no such file, wherever Spark would read it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return read_csv(spark, path) if there else None


def _field(df: DataFrame, *names: str):
    """The first of the columns that the file has, whatever its case, blanks and underscores; null if none."""
    have = {c.lower().replace(" ", "").replace("_", ""): c for c in df.columns}
    for n in names:
        if (c := have.get(n.lower().replace(" ", "").replace("_", ""))) is not None:
            return F.trim(F.col(f"`{c}`"))
    return F.lit(None).cast("string")


def describe_tables(df: DataFrame, database: str) -> DataFrame:
    """(database, table_name, description) of a list of tables; of repeated names the last counts."""
    rows = df.select(_field(df, "TABLE_NAME", "TABLE", "NAME").alias("table_name"), F.coalesce(_field(df, "DESCRIPTION", "DETAILS"), F.lit("")).alias("description"), F.monotonically_increasing_id().alias("_at"))
    one = rows.where("table_name <> ''").groupBy("table_name").agg(F.max_by("description", "_at").alias("description"))
    return one.select(F.lit(database).alias("database"), "table_name", "description")


def columns_catalog(df: DataFrame, database: str, table_name: str | None = None) -> DataFrame:
    """Column rows of a schema file; without an ordinal the order of the file counts."""
    table = F.lit(table_name) if table_name else _field(df, "TABLE_NAME", "TABLE")
    at = F.monotonically_increasing_id()
    rows = df.select(F.lit(database).alias("database"), table.alias("table_name"), _field(df, "COLUMN_NAME", "COLUMN", "NAME").alias("column_name"), safe_int(_field(df, "ORDINAL_POSITION", "ORDINAL")).alias("ordinal"), _field(df, "DATA_TYPE", "TYPE").alias("data_type"), F.coalesce(_field(df, "DESCRIPTION", "COMMENT"), F.lit("")).alias("description"), at.alias("_at"))
    rows = rows.where("column_name <> '' and table_name <> ''")
    order = F.row_number().over(Window.partitionBy("database", "table_name").orderBy("ordinal", "_at"))
    return rows.withColumn("ordinal", order).drop("_at")


def group_columns(columns: DataFrame) -> DataFrame:
    """(database, table_name, columns): each table's columns in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "description")))
    return columns.groupBy("database", "table_name").agg(ordered.alias("parts")).select("database", "table_name", F.transform("parts", lambda p: p["column_name"]).alias("columns"), "parts")


def merge_details(data: DataFrame, details: DataFrame, relationships: DataFrame, database: str) -> DataFrame:
    """Tables of a data file with what two more files say of them; every table of the data file stays."""
    a = data.select(_field(data, "TABLE_NAME", "TABLE").alias("table_name"), safe_int(_field(data, "ROW_COUNT", "ROWS")).cast("long").alias("row_count"), safe_text(_field(data, "PRIMARY_KEY", "PRIMARY_KEYS")).alias("primary_key"))
    b = details.select(_field(details, "TABLE_NAME", "TABLE").alias("table_name"), _field(details, "DESCRIPTION", "DETAILS").alias("description")).dropDuplicates(["table_name"])
    c = relationships.select(_field(relationships, "TABLE_NAME", "TABLE").alias("table_name"), _field(relationships, "RELATIONSHIP", "RELATIONSHIPS").alias("relationship_text")).dropDuplicates(["table_name"])
    out = a.where("table_name <> ''").join(b, "table_name", "left").join(c, "table_name", "left")
    return out.select(F.lit(database).alias("database"), "table_name", F.coalesce("description", F.lit("")).alias("description"), F.array_compact(F.array("primary_key")).alias("primary_keys"), "row_count", F.coalesce("relationship_text", F.lit("")).alias("relationship_text"))


def keep_known(rows: DataFrame, tables: DataFrame, name: str = "table_name") -> tuple[DataFrame, DataFrame]:
    """Rows whose table is known, and rows whose table isn't."""
    return rows.join(tables.select(name), name, "left_semi"), rows.join(tables.select(name), name, "left_anti")


def table_filter(spark: SparkSession, path: str) -> DataFrame:
    """Table names of a file, one a line; blank lines and those that begin with # or - don't count."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("table_name")).where("table_name <> ''").where(~F.col("table_name").startswith("#") & ~F.col("table_name").startswith("-")).distinct()


class Catalog:
    """All sources' tables by logical database."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def get_all_tables(self, database: str) -> DataFrame:
        if database not in self.tables:
            raise ValueError(f"unknown database {database}")
        return self.tables[database]

    def table_infos(self, database: str) -> DataFrame:
        """(table_name, info): each table's catalog row as text."""
        df = self.get_all_tables(database)
        titles = {"table_name": "Table", "description": "Description", "columns": "Columns", "primary_keys": "Primary keys", "row_count": "Rows", "relationship_text": "Relationships"}
        value = lambda c: F.concat_ws(", ", c) if c in ("columns", "primary_keys") else F.col(c).cast("string")
        lines = [F.concat(F.lit(f"{title}: "), value(c)) for c, title in titles.items() if c in df.columns]
        return df.select("table_name", F.concat_ws("\n", *lines).alias("info"))

    def table_info_text(self, database: str, table: str) -> str:
        """A table's catalog row as text; says so if there is none."""
        row = self.table_infos(database).where(F.col("table_name") == table).limit(1).collect()
        return row[0]["info"] if row else f"Table {table} is not in {database}"
