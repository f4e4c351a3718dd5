"""Profiles of tables: counts, summaries and the most frequent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_values(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column_name, value, n): the most frequent values of each column, ties by value.

    All columns are counted in one pass: each row gives its values as
    (column, value) pairs, which are counted before they are shuffled.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("value")))
    return counts.withColumn("rn", rank).where(F.col("rn") <= top).drop("rn")


#: Of quantile sketches; with it a quantile's rank is within ``RANK_ERROR`` of the one asked for, as a share of the rows.
SKETCH_K, RANK_ERROR = 800, 0.01
QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: list[str], k: int = SKETCH_K) -> DataFrame:
    """(column_name, n, nulls, mean, deviation, least, lower, median, upper, most) of numeric columns, in one pass.

    Quartiles come from mergeable sketches of bounded size, one for each task and
    column; up to some ``k`` values they are exact.
    """
    low, mid, high = QUARTILES
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.avg(c).cast("double").alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__deviation"),
            F.min(x).alias(f"{c}__least"), F.max(x).alias(f"{c}__most"), F.kll_sketch_agg_double(x, k).alias(f"{c}__sketch"),
        ]
    one = df.agg(*aggs)

    def row(c: str):
        at = lambda q: F.when(F.col(f"{c}__n") > 0, F.kll_sketch_get_quantile_double(f"{c}__sketch", F.lit(q)))
        plain = [F.col(f"{c}__{m}").alias(m) for m in ("n", "nulls", "mean", "deviation", "least")]
        return F.struct(F.lit(c).alias("column_name"), *plain, at(low).alias("lower"), at(mid).alias("median"), at(high).alias("upper"), F.col(f"{c}__most").alias("most"))

    return one.select(F.explode(F.array(*map(row, columns))).alias("r")).select("r.*")


def wide_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of all tables with the columns of any; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
