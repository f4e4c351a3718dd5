"""Connected components of a table of edges, by minimum labels and pointer jumping.

Labels never leave the executors; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.scratch import remove, tables_made


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; the label is the least node of its component.

    Edges with a null end and loops are left out; an empty table gives none.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(ends.union(ends.select("v", "u")).distinct(), "edges")
    with tables_made() as old:
        labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        hop = lower.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        with tables_made() as new:
            after = materialize(lower.join(hop, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        remove(edges.sparkSession, old)
        labels, old = after.select("node", "label"), new
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return labels
