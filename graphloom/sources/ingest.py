"""From files to typed tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import coerce, safe_text


def load_table(df: DataFrame, rename: dict[str, str] | None = None, kinds: dict[str, str] | None = None, key: str | None = None, default: str = "text") -> DataFrame:
    """Renames and types columns, and drops rows that are empty or have no key.

    ``kinds`` gives int, float, date or text by column; what can't be read is
    null.
    """
    df = df.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in df.columns})
    kinds = kinds or {}
    out = df.select(*[coerce(F.col(f"`{c}`"), kinds.get(c, default)).alias(c) for c in df.columns]).dropna(how="all")
    return out.where(F.col(key).isNotNull()) if key else out


def read_csv_table(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", **how) -> DataFrame:
    return load_table(spark.read.option("header", True).option("encoding", encoding).csv(path), **how)


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's rows over JDBC; ``partition`` (column, least, most, parts) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        col, low, high, parts = partition
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", col).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()
    return reader.option("query", query).load()


def export_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Writes CSV with a header, quotes inside a field doubled; as one file only if asked, since that is one task's work."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fill_names(df: DataFrame, names: DataFrame, name_col: str = "name", key: str = "iga") -> DataFrame:
    """Gives rows with a blank name the names of ``names`` (n, name) by their order of keys; what lacks a name stays null.

    Blank rows are numbered in ranges of the key, so no task sees all of them.
    """
    from graphloom.operators.synth import numbered

    blank = F.coalesce(F.trim(name_col), F.lit("")) == ""
    need = numbered(df.where(blank).select(key), key).join(names.select(F.col("n").alias("_n"), F.col("name").alias("_name")), F.col("rn") == F.col("_n"), "left")
    return df.join(need.select(key, "_name"), key, "left").withColumn(name_col, F.when(blank, F.col("_name")).otherwise(F.col(name_col))).drop("_name")


def with_email(df: DataFrame, name_col: str, domain: str) -> DataFrame:
    from graphloom.functions import email_of

    return df.withColumn("email", email_of(safe_text(F.col(name_col)), domain))
