"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

Components are scaled to integers, and all that is decided is decided on them.
Distances are screened by a float32 matrix product: what rounding can do to an
entry's distance is bounded, so each distance is known within an interval, and
every entry whose interval reaches the best one is worked out again in int64;
equal distances go to the lower index.  So codes are those of exact arithmetic,
whatever order a matrix product adds in.

A codebook starts from the first vectors by id; each round is one pass in which
a task adds up the parts of each entry and gives those sums, a few rows, to the
shuffle.  What the driver holds are codebooks: ``PARTS`` x ``ENTRIES`` entries.

The interval.  For integers x, c of ``d`` components, float32 has x (1+e) and
c (1+e) with |e| <= u = 2^-24, and their product summed in any order is within
g sum|x c| of sum x c, where g = m u / (1 - m u) and m = d + 2.  By Cauchy and
Schwarz sum|x c| <= |x| |c|, which are taken in float64 and rounded up.  The
distance less |x|^2 is |c|^2 - 2 x c; it is formed in float64, whose own
rounding, below 2^-50 of |c|^2 + 2 |x c|, is added to the interval.

Defined cases: a row whose vector is null, or holds a null or a component that
isn't finite, is dropped, and so is one whose vector has another length than the
first one (by id) that can be cut into equal parts; an id that several rows have
is ordered by components; rows without an id come last; labels may be null;
with fewer vectors than entries each codebook is that much smaller; an empty
table gives an empty result; components beyond +-2^18 would not fit int64
distances and raise ValueError; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once; their intervals take 16 bytes for each part and entry.
STRIP = 1024
#: Integers up to this size keep squared distances of parts of up to 256 components within int64.
MOST_COMPONENT = 1 << 26
#: Label sums up to this number are broadcast (some 5 MB); more are joined by a shuffle.
MOST_LABELS = 100_000
UNIT = 2.0**-24


def integers(column: pa.ListArray, dim: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are kept, and their components as integers."""
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    kept = np.flatnonzero((sizes == dim) & (bad[ends] == bad[ends - np.maximum(sizes, 0)]))
    rows = x[(ends[kept] - dim)[:, None] + np.arange(dim)] if len(kept) else np.zeros((0, dim))
    scaled = np.floor(rows * scale)
    if scaled.size and np.abs(scaled).max() > MOST_COMPONENT:
        raise ValueError(f"components beyond +-{MOST_COMPONENT // scale} can't be coded")
    return kept, scaled.astype(np.int64)


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component) of rows of vectors."""
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each (part, row), the lowest of equals, and its squared distance; all int64."""
    parts, n, d = x.shape
    norms = (books * books).sum(axis=2)
    product = np.matmul(x.astype(np.float32), books.astype(np.float32).transpose(0, 2, 1)).astype(np.float64)
    m = d + 2
    g = m * UNIT / (1 - m * UNIT)
    length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=2)) * (1 + 2.0**-40)
    slack = 2 * g * length(x)[:, :, None] * length(books)[:, None, :]
    slack += 2.0**-50 * (norms[:, None, :] + 2 * np.abs(product) + slack)
    product *= -2
    product += norms[:, None, :]
    least = product - slack
    product += slack
    near = least <= product.min(axis=2, keepdims=True)
    best = near.argmax(axis=2)
    several = np.flatnonzero(near.sum(axis=2).ravel() > 1)
    if len(several):
        at, entry = np.nonzero(near.reshape(parts * n, -1)[several])
        row = several[at]
        exact = x.reshape(parts * n, d)[row] - books[row // n, entry]
        exact = (exact * exact).sum(axis=1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        lowest = np.minimum.reduceat(exact, first)
        # entries of a row stand in order: the first of those that are as near as the nearest counts
        hit = np.flatnonzero(exact == lowest[at])
        hit = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
        best.reshape(-1)[several] = entry[hit]
    gap = x - np.take_along_axis(books, best[:, :, None], axis=1)
    return best, (gap * gap).sum(axis=2)


def strips(batches: Iterator[pa.RecordBatch], column: int, dim: int, parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The kept rows of bounded parts of the batches, with their vectors cut into parts."""
    for batch in batches:
        for i in range(0, batch.num_rows, STRIP):
            some = batch.slice(i, STRIP)
            kept, vectors = integers(some.column(column), dim, scale)
            if len(kept):
                yield some, kept, cut(vectors, parts)


def _kept(df: DataFrame, vector_col: str) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vector_col).isNotNull() & finite)


class Codebooks:
    """Codebooks learnt from all vectors of ``df``, and what is coded by them."""

    def __init__(self, df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        self.id_col, self.vector_col, self.parts, self.entries, self.scale = id_col, vector_col, parts, entries, scale
        whole = _kept(df, vector_col).where((F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
        order = [F.col(id_col).asc_nulls_last(), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).asc()]
        first = whole.orderBy(*order).limit(entries).select(F.size(vector_col).alias("dim"), vector_col).toArrow()
        self.dim = int(first["dim"][0].as_py()) if first.num_rows else 0
        if first.num_rows and pc.count_distinct(first["dim"]).as_py() > 1:
            first = whole.where(F.size(vector_col) == self.dim).orderBy(*order).limit(entries).select(F.size(vector_col).alias("dim"), vector_col).toArrow()
        self.entries_of = cut(integers(first[vector_col].combine_chunks(), self.dim, scale)[1], parts) if first.num_rows else np.zeros((parts, 0, 0), np.int64)
        for _ in range(rounds if self.dim else 0):
            self._round(df)

    def _round(self, df: DataFrame) -> None:
        """One pass: each entry becomes the mean, rounded down, of the parts nearest to it; one without any stays."""
        books, dim, parts, scale = self.entries_of, self.dim, self.parts, self.scale
        d, k = dim // parts, books.shape[1]

        def run(batches):
            sums, counts = np.zeros((parts * k, d), np.int64), np.zeros(parts * k, np.int64)
            for _, _, x in strips(batches, 0, dim, parts, scale):
                best, _ = nearest(x, books)
                flat = (best + k * np.arange(parts)[:, None]).ravel()
                counts += np.bincount(flat, minlength=parts * k)
                np.add.at(sums, flat, x.reshape(-1, d))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, j]) for j in range(d))], ["entry", "n", *(f"s{j}" for j in range(d))])

        names = [f"s{j}" for j in range(d)]
        added = df.select(self.vector_col).mapInArrow(run, "entry long, n long, " + ", ".join(f"{s} long" for s in names))
        for r in added.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():
            books[r["entry"] // k, r["entry"] % k] = [r[s] // r["n"] for s in names]

    def digest(self) -> str:
        """Of all entries' components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries_of.ravel().tolist())).encode()).hexdigest()

    def encode(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(id, the columns ``keep``, code, error) of each vector that is kept: its parts' indexes as two hex digits each, and the sum of their squared distances."""
        books, dim, parts, scale = self.entries_of, self.dim, self.parts, self.scale
        digits = 2 if books.shape[1] <= 256 else 4
        cols = [self.id_col, *keep]
        places = len(cols)

        def run(batches):
            for batch, kept, x in strips(batches, places, dim, parts, scale):
                best, gaps = nearest(x, books)
                raw = best.T.astype(">u2" if digits == 4 else np.uint8)
                codes = [r.tobytes().hex() for r in raw]
                own = pa.array(kept)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(places)), pa.array(codes, pa.string()), pa.array(gaps.sum(axis=0))], [*(f"c{i}" for i in range(places)), "code", "error"])

        given = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], F.col(self.vector_col).alias("vector"))
        fields = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))
        if not dim:
            return given.limit(0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        out = given.mapInArrow(run, f"{fields}, code string, error long")
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "code", "error")

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for, in integers."""
        digits = 2 if self.entries_of.shape[1] <= 256 else 4
        at = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)]
        return np.concatenate([self.entries_of[p, e] for p, e in enumerate(at)])


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together.

    Errors are added up in the tasks first; the join's hot labels are split by
    adaptive execution, or the sums are broadcast where their number is small.
    """
    own = fresh(coded, "_label")
    sums = coded.groupBy(F.col(label_col).alias(own)).agg(F.sum("error").alias("label_error"))
    small = sums.count() <= MOST_LABELS
    return coded.join(F.broadcast(sums) if small else sums.hint("merge"), F.col(label_col).eqNullSafe(F.col(own))).drop(own)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = Codebooks(vectors)
    coded = materialize(books.encode(vectors, ("label",)), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _near_sql(n: int) -> str:
    """The nearest entry of book ``n`` for each part; distance and index are one number, so that the lower index wins."""
    return f"""near{n} AS (
  SELECT a.r, a.p, a.x, min(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) * 64 + b.k) AS best FROM parts a JOIN book{n} b USING (p) GROUP BY ALL)"""


def _means_sql(n: int) -> str:
    """Book ``n + 1``: the means of the parts nearest to each entry, rounded down."""
    return f"""mean{n} AS (
  SELECT p, best % 64 AS k, i, sum(x[i]) AS s, count(*) AS c FROM near{n}, range(1, (SELECT max(len(x)) FROM parts) + 1) t(i) GROUP BY ALL),
book{n + 1} AS (
  SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{n} b
  LEFT JOIN (SELECT p, k, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM mean{n} GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vectors AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM kept),
parts AS (
  SELECT r, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM vectors, range(16) t(p)),
book0 AS (
  SELECT p, r - 1 AS k, x FROM parts WHERE r <= 64),
{_near_sql(0)},
{_means_sql(0)},
{_near_sql(1)},
{_means_sql(1)},
{_near_sql(2)},
coded AS (
  SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near2 GROUP BY r),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM vectors JOIN coded USING (r), digest
"""
