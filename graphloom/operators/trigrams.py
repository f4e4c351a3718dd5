"""Substring search without scanning: a stored table of trigram postings.

Each text gives its distinct groups of three characters, in lower case, as rows
(gram, field, id), stored in folders by a hash of the gram and sorted in them.  A
keyword reads the folders of its own trigrams only; what has all of them in one
field is a candidate, and only candidates are joined to the table and verified.
A keyword of fewer than three characters has no trigram: then all is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

BUCKETS = 256


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none of a null or short one."""
    low = F.lower(text)
    return F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, path: str, fields: list[str], id_col: str = "id", buckets: int = BUCKETS) -> TrigramIndex:
        """Stores the postings of text columns, and of columns that are arrays of texts."""
        def of(c: str) -> Column:
            if isinstance(df.schema[c].dataType, ArrayType):
                return F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: grams(x))))
            return grams(F.col(c).cast("string"))

        def posted(c: str) -> Column:
            return F.transform(of(c), lambda g: F.struct(g.alias("gram"), F.lit(c).alias("field")))

        each = F.explode(F.flatten(F.array(*map(posted, fields))))
        rows = df.select(F.col(id_col).alias("id"), each.alias("p")).select("p.*", "id").distinct()
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        # adaptive execution splits the folders of frequent trigrams
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)
        df.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}.settings")
        return cls(df.sparkSession, path)

    def wanted(self, keyword: str) -> list[tuple[int, str]]:
        """The keyword's trigrams, each with its folder."""
        buckets = self.spark.read.parquet(f"{self.path}.settings").first()[0]
        found = self.spark.range(1).select(F.explode(grams(F.lit(keyword))).alias("g")).select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"), "g")
        return sorted((r[0], r[1]) for r in found.collect())

    def postings(self, keyword: str) -> DataFrame | None:
        """(gram, field, id) of the keyword's trigrams; None if it has none."""
        wanted = self.wanted(keyword)
        if not wanted:
            return None
        return self.spark.read.parquet(self.path).where(F.col("bucket").isin(sorted({b for b, _ in wanted})) & F.col("gram").isin([g for _, g in wanted]))

    def candidates(self, keyword: str, fields: list[str] | None = None) -> DataFrame | None:
        """The ids of what may hold the keyword in one of the fields; None if that can't be told without a scan."""
        rows = self.postings(keyword)
        if rows is None:
            return None
        if fields is not None:
            rows = rows.where(F.col("field").isin(fields))
        n = len(self.wanted(keyword))
        return rows.groupBy("id", "field").agg(F.count("*").alias("n")).where(F.col("n") == n).select("id").distinct()

    def narrowed(self, df: DataFrame, keywords: list[str], fields: list[str] | None = None, id_col: str = "id") -> DataFrame:
        """The rows that may hold one of the keywords; they are still to be verified."""
        found = [self.candidates(k, fields) for k in keywords]
        if any(x is None for x in found) or not found:
            return df
        ids = found[0]
        for more in found[1:]:
            ids = ids.union(more)
        return df.join(ids.distinct().withColumnRenamed("id", id_col), id_col, "left_semi").select(*df.columns)
