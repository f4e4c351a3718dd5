"""Structured Streaming: windowed counts over event files, and pushes of tables and concepts into a graph store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.store import GraphStore, push

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum of values, by window and type; events later than ``late`` don't count in a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what a stream has by now as Parquet, and ends; a restart goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_stream(rows: DataFrame, store: GraphStore, checkpoint: str, name: str = "push"):
    """Adds what a stream brings to a store, once: rows have ``vertex`` and ``edge``, structs of which one is null.

    A batch's number is committed together with its rows.  A batch that was
    committed, and that Spark runs again because it was killed before it noted
    so, changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        vertices, edges = (batch.where(F.col(kind).isNotNull()).select(f"{kind}.*") for kind in ("vertex", "edge"))
        push(store, vertices, edges, (name, number))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
