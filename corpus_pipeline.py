"""A pipeline that turns ``documents`` into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again.  All but the last return the
columns of ``documents``.

Defined cases are those of the operators: a document without a letter is
rejected by the first stage; an empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, langid, line_dedup, mixing, near_dup
from graphloom.llm.common import materialize, table
from graphloom.scratch import remove, tables_made


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learnt from their own labels."""
    return langid.keep_accepted(docs, langid.fit_documents(docs, langid.remainder("doc_id", 3) != 1))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the largest document id only; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*[_length(docs) if c == "n_chars" else out[f"`{c}`"] for c in docs.columns])


def _length(docs: DataFrame):
    from pyspark.sql import functions as F

    return F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), how="documents")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.Mix(docs).totals()


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Trained models and drawn blocks aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_made() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # a stage's own tables, and its input, aren't read again
        remove(spark, last + made[:-1])
        last = made[-1:]
    return docs
