"""Line deduplication with two Bloom filters.

Pass one marks the hashes of line keys in a once-seen and a twice-seen filter,
for each input partition; the partial filters are merged segment by segment (a
key that is once-seen on two sides becomes twice-seen).  Pass two lets only
lines whose key the twice-seen filter holds through to a shuffle, where the
keys themselves are compared: documents are counted and the first occurrence,
the largest document id, is chosen.  Filters never lose a repeat, so the result
is exact; a fuller filter only lets more lines through.

A filter's size follows the input up to ``MOST_BITS`` (64 MB), which bounds
what is broadcast.

Defined cases: a null or empty text is one empty line and is returned as it
is; rows of one document id are one document; rows without an id are never the
chosen ones and don't count as a document, but lose repeated lines; all lines
of a key stay in the chosen document; an empty table gives an empty one; a very
long text is one slice of its own and is read whole; extra columns are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import fresh, list_array, materialize, sliced, table

MIN_CHARS = 20
MIN_DOCS = 3
SEGMENT_BITS = 1 << 16
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
#: A task packs the filters of so many hashes at once, which bounds its memory.
FLUSH_HASHES = 1 << 20


class _Lines:
    """The lines of a slice of texts, their stripped spans and their keys' hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, min_chars: int):
        low = bt.LOWER[data]
        breaks = np.flatnonzero(data == 0x0A)
        texts = len(offs) - 1
        # a text's lines begin at its start and after each of its breaks
        own = np.searchsorted(breaks, offs)
        self.counts = np.diff(own) + 1
        self.at = np.concatenate(([0], np.cumsum(self.counts)))
        starts = np.empty(self.at[-1], dtype=np.int64)
        first = np.zeros(self.at[-1], dtype=bool)
        first[self.at[:-1]] = True
        starts[first] = offs[:-1]
        starts[~first] = breaks + 1
        ends = np.empty_like(starts)
        last = np.zeros(self.at[-1], dtype=bool)
        last[self.at[1:] - 1] = True
        ends[last] = offs[1:]
        ends[~last] = breaks
        self.starts, self.ends, self.low = starts, ends, low
        solid = np.flatnonzero(~bt.BLANK[data])
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = b > a
        self.key_starts, self.key_ends = starts.copy(), starts.copy()
        self.key_starts[full], self.key_ends[full] = solid[a[full]], solid[b[full] - 1] + 1
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.long = points[self.key_ends] - points[self.key_starts] >= min_chars
        self.hashes = np.zeros(self.at[-1], dtype=np.uint64)
        self.hashes[self.long] = bt.span_hashes(low, self.key_starts[self.long], self.key_ends[self.long])
        self.doc = np.repeat(np.arange(texts), self.counts)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, hash, a line) of the long keys, once for each document; keys are told apart by their bytes."""
        lines = np.flatnonzero(self.long)
        number = bt.span_numbers(self.low, self.key_starts[lines], self.key_ends[lines])
        order = np.lexsort((number, self.doc[lines]))
        lines, number = lines[order], number[order]
        new = np.ones(len(lines), dtype=bool)
        new[1:] = (number[1:] != number[:-1]) | (self.doc[lines][1:] != self.doc[lines][:-1])
        lines = lines[new]
        return self.doc[lines], self.hashes[lines], lines


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash has two bits of one segment."""
    segment = (hashes >> bt.U64(32)) % bt.U64(bits // SEGMENT_BITS) * bt.U64(SEGMENT_BITS)
    return segment + (hashes & bt.U64(0xFFFF)), segment + (hashes >> bt.U64(16) & bt.U64(0xFFFF))


def _mark(bits: int, min_chars: int, flush: int = FLUSH_HASHES):
    """The segments of a partition's two filters that have bits set; of a large partition those of each ``flush`` hashes."""

    def packed(places: np.ndarray, segment: int) -> bytes:
        own = np.zeros(SEGMENT_BITS, dtype=bool)
        own[places - segment * SEGMENT_BITS] = True
        return zlib.compress(np.packbits(own).tobytes(), 1)

    def emit(held: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        once = np.sort(np.concatenate(_probes(values, bits)).astype(np.int64))
        twice = np.sort(np.concatenate(_probes(values[counts > 1], bits)).astype(np.int64))
        segments = np.unique(once // SEGMENT_BITS)
        edges = [np.searchsorted(x, np.append(segments, segments[-1] + 1) * SEGMENT_BITS) for x in (once, twice)] if len(segments) else None
        ends = [np.searchsorted(x, (segments + 1) * SEGMENT_BITS) for x in (once, twice)]
        for k in range(0, len(segments), 64):
            part = range(k, min(k + 64, len(segments)))
            cols = [[packed(x[edges[f][i] : ends[f][i]], int(segments[i])) for i in part] for f, x in enumerate((once, twice))]
            yield pa.RecordBatch.from_arrays([pa.array([int(segments[i]) for i in part], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["segment", "once", "twice"])

    def run(batches):
        held, size = [], 0
        for _, data, offs in sliced(batches, 0):
            held.append(_Lines(data, offs, min_chars).distinct()[1])
            size += len(held[-1])
            if size > flush:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _merge_segments(batches):
    """Merges the rows of a segment, which follow each other, one by one."""
    now, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for segment, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if segment != now:
                if now is not None:
                    yield done()
                now, once, twice = segment, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if now is not None:
        yield done()


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, bits: int | None = None) -> tuple[Broadcast, int]:
    """The twice-seen filter over all lines (packed bits), and its size in bits."""
    if bits is None:
        size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size // 16).bit_length()))
    parts = docs.select(F.col(text_col)).mapInArrow(_mark(bits, min_chars), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_segments, "segment int, twice binary")
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():
        packed[r["segment"] * SEGMENT_BITS // 8 : (r["segment"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(packed), bits


def _suspects(held: Broadcast, bits: int, min_chars: int):
    """(id, key) of the lines whose key the filter holds, once for each row."""

    def run(batches):
        packed = held.value
        for batch, data, offs in sliced(batches, 1):
            lines = _Lines(data, offs, min_chars)
            doc, hashes, line = lines.distinct()
            p, q = _probes(hashes, bits)
            hit = np.ones(len(hashes), dtype=bool)
            for x in (p, q):
                hit &= (packed[x >> bt.U64(3)] >> (bt.U64(7) - (x & bt.U64(7))).astype(np.uint8) & 1).astype(bool)
            doc, line = doc[hit], line[hit]
            keys = [lines.low[a:b].tobytes() for a, b in zip(lines.key_starts[line].tolist(), lines.key_ends[line].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(keys, pa.binary())], ["id", "key"])

    return run


def _hashes(keys: pa.Array) -> np.ndarray:
    data, offs = bt.column_bytes(keys)
    return bt.span_hashes(data, offs[:-1], offs[1:])


def _drop(keep: list[str], text: str, min_chars: int, names: tuple[str, str, str]):
    """Joins the lines that stay; null texts stay null."""
    n_lines, n_dropped, gone = names

    def run(batches):
        for batch, data, offs in sliced(batches, text):
            lines = _Lines(data, offs, min_chars)
            lists = batch.column(gone)
            keys, out, dropped = lists.flatten(), batch.column(text).to_pylist(), np.zeros(batch.num_rows, dtype=np.int64)
            key_hashes, to = _hashes(keys), np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            for d in np.flatnonzero(np.diff(to)).tolist():
                a, b = lines.at[d], lines.at[d + 1]
                maybe = np.flatnonzero(lines.long[a:b] & np.isin(lines.hashes[a:b], key_hashes[to[d] : to[d + 1]])) + a
                # hashes only say where to look: the keys themselves decide
                own = set(keys.slice(to[d], to[d + 1] - to[d]).to_pylist())
                lose = {k for k in maybe.tolist() if lines.low[lines.key_starts[k] : lines.key_ends[k]].tobytes() in own}
                if lose:
                    dropped[d] = len(lose)
                    out[d] = b"\n".join(data[lines.starts[k] : lines.ends[k]].tobytes() for k in range(a, b) if k not in lose).decode("utf-8")
            cols = [pa.array(out, batch.column(c).type) if c == text else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines.counts.astype(np.int64)), pa.array(dropped)], [*keep, n_lines, n_dropped])

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped from their text, and two more columns: lines before, and lines dropped."""
    names = fresh(docs, "n_lines"), fresh(docs, "n_dropped"), fresh(docs, "_gone")
    losing_id = fresh(docs, "_losing_id")
    held, bits = twice_seen(docs, text_col, min_chars, bits)
    kind = docs.schema[id_col].dataType.simpleString()
    suspects = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_suspects(held, bits, min_chars), f"id {kind}, key binary"), "line-suspects")
    repeated = suspects.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("first_id")).where(F.col("n") >= min_docs)
    repeated = materialize(repeated.select(F.col("key").alias("repeated_key"), "first_id"), "line-repeats")
    losing = suspects.join(repeated, F.col("key") == F.col("repeated_key")).where(~F.col("id").eqNullSafe(F.col("first_id")))
    lost = losing.groupBy(F.col("id").alias(losing_id)).agg(F.collect_set("key").alias(names[2]))
    joined = docs.join(lost.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(losing_id)), "left").drop(losing_id)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_drop(docs.columns, text_col, min_chars, names), f"{plain}, `{names[0]}` long, `{names[1]}` long")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``documents`` after line deduplication."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS first_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.first_id) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
