"""Fill-in-the-middle transformation, in Spark SQL expressions.

A text is cut into units (a word with the white space before it; white space at
the end) and its units into prefix, middle and suffix, at two places drawn from
a hash of the row's id.  Rows become ``psm`` (prefix, suffix, middle) or ``spm``
(suffix, prefix, middle) arrangements with sentinels, or stay ``plain``; which,
the same hash says, so that a rerun and a lost executor change nothing.
``restored`` reads the text back from an arrangement by its sentinels.

A row is transformed where it is: no shuffle, no Python.  Work memory is the
text, its array of units and the arrangement.

Defined cases: a null text is empty; an empty text, or one that holds a
sentinel, stays plain, so that sentinels of an arrangement are never text;
a null id is hashed as an empty one; rows of one id are cut at the same
draws, equal rows alike; a very long text is one row, read whole; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
#: Of 100 rows so many are arranged, and of 100 arranged ones so many are spm.
SHARE, SPM_SHARE = 50, 80


@dataclass(frozen=True)
class Sentinels:
    """Marks before the parts; none may begin within another, so that each is found where it was put."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.all()
        for a in marks:
            for b in marks:
                if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b):
                    raise ValueError(f"sentinels overlap: {a!r} and {b!r}")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(id_: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an arrangement was made of."""
    p, s, m = sentinels.all()
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, sentinels: Sentinels = Sentinels()) -> DataFrame:
    """(id, n, form, output, prefix_chars, middle_chars) of each row: its units, its form, its arrangement, and the parts' code points (null if plain)."""
    p, s, m = map(F.lit, sentinels.all())
    # each step reads what the one before worked out once: the units aren't matched again for every part
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), draws(F.col("id"), seed).alias("h"))
    rows = rows.select("*", F.size("units").cast("long").alias("n"))
    place = lambda k: (F.col("h")[k] % (F.col("n") + 1)).cast("int")
    marked = (F.col("text") == "") | F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when(marked | (F.col("h")[2] % 100 >= share), "plain").when(F.col("h")[3] % 100 < spm_share, "spm").otherwise("psm")
    rows = rows.select("id", "text", "units", "n", F.least(place(0), place(1)).alias("a"), F.greatest(place(0), place(1)).alias("b"), form.alias("form"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    a, b = F.col("a"), F.col("b")
    rows = rows.select("id", "text", "n", "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.greatest(F.lit(0), F.col("n").cast("int") - b)).alias("suffix"))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n"), "form", output.alias("output"),
        F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrangement of every document, as digests of it and of the text restored from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(units[greatest(c1, c2) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
