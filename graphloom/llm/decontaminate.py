"""Benchmark decontamination.

The benchmark's windows of ten normalised words form a hash set that is
broadcast.  Document texts are scanned window by window; hashes that hit are
verified word by word; hit words are merged to spans, which can be reported,
cut out of the text, or taken as a reason to drop the document.

The set's size is checked: at most ``PART_WINDOWS`` windows are broadcast at
once.  A larger benchmark is dealt into parts by hash and the documents are
scanned once per part, each pass adding to the spans of the one before.

Defined cases: a null or empty text has no words and no hits; an item without
words never occurs; an item of fewer than ten words is one window of all its
words; equal items each count; a null item id reads as an empty string; extra
columns of the documents are kept by ``remove`` and ignored by ``report``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import fresh, list_array, materialize, sliced, table

WINDOW = 10
#: Windows in one broadcast: some 200 MB in a worker.
PART_WINDOWS = 400_000

Window = tuple[int, int, bytes, str]  # hash, words, normalised text, item


def _item_windows(batches):
    """Rows of (hash, size, window, item) for the items' windows."""
    for batch, data, offs in sliced(batches, "text"):
        hashes, starts, ends, at = bt.words(data, offs)
        low = bt.LOWER[data]
        windows, to = bt.text_windows(hashes, at, WINDOW)
        items = batch.column(batch.schema.get_field_index("item")).to_pylist()
        text, item, size = [], [], []
        for i in range(len(offs) - 1):
            for k in range(to[i + 1] - to[i]):
                first = at[i] + k
                last = min(first + WINDOW, at[i + 1])
                text.append(_spell(low, starts, ends, first, last))
                item.append(items[i] or "")
                size.append(last - first)
        yield pa.RecordBatch.from_arrays([pa.array(windows.astype(np.int64)), pa.array(size, pa.int32()), pa.array(text, pa.binary()), pa.array(item, pa.string())], ["hash", "size", "window", "item"])


def _spell(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> bytes:
    return b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(first, last))


def window_parts(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", part_windows: int = PART_WINDOWS) -> list[Broadcast]:
    """The benchmark's windows, broadcast in parts of about ``part_windows`` at most."""
    spark = bench.sparkSession
    rows = materialize(
        bench.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(_item_windows, "hash long, size int, window binary, item string").distinct(),
        "benchmark-windows",
    )
    parts = max(1, -(-rows.count() // part_windows))
    out = []
    for p in range(parts):
        index: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for r in rows.where(F.pmod(F.col("hash"), F.lit(parts)) == p).toLocalIterator():
            index.setdefault(r["size"], {}).setdefault(r["hash"] & 0xFFFFFFFFFFFFFFFF, {}).setdefault(bytes(r["window"]), set()).add(r["item"])
        out.append(spark.sparkContext.broadcast(index))
    return out


class _Matcher:
    """Finds the windows of one part in slices of texts."""

    def __init__(self, index: dict[int, dict[int, dict[bytes, set[str]]]]):
        self.index = index
        self.known = {}
        for size, by_hash in index.items():
            hashes = np.sort(np.fromiter(by_hash, dtype=np.uint64, count=len(by_hash)))
            marks = np.zeros(1 << 20, dtype=bool)
            marks[hashes >> bt.U64(44)] = True
            self.known[size] = hashes, marks

    def find(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Per-text word counts, word offsets, and for texts with hits their word ranges and items."""
        hashes, starts, ends, at = bt.words(data, offs)
        low = bt.LOWER[data]
        hits: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for size, (known, marks) in self.known.items():
            windows = bt.window_hashes(hashes, size)
            maybe = np.flatnonzero(marks[windows >> bt.U64(44)])
            found = known[np.minimum(np.searchsorted(known, windows[maybe]), len(known) - 1)] == windows[maybe]
            maybe = maybe[found]
            doc = np.searchsorted(at, maybe, side="right") - 1
            inside = maybe + size <= at[doc + 1]
            for k, d in zip(maybe[inside].tolist(), doc[inside].tolist(), strict=True):
                items = self.index[size][int(windows[k])].get(_spell(low, starts, ends, k, k + size))
                if items:
                    ranges, names = hits.setdefault(d, ([], set()))
                    ranges.append((k - int(at[d]), k - int(at[d]) + size))
                    names |= items
        return np.diff(at), at, hits


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(part: Broadcast, text: str, n_words: str, spans: str, items: str, first: bool):
    """Adds the word count, hit spans and items of one part to each row."""

    def run(batches):
        matcher = _Matcher(part.value)
        for batch, data, offs in sliced(batches, text):
            counts, _, hits = matcher.find(data, offs)
            rows = batch.num_rows
            old = [[] for _ in range(rows)], [[] for _ in range(rows)]
            if not first:
                old = ([[(s["start"], s["stop"]) for s in x] for x in batch.column(spans).to_pylist()], batch.column(items).to_pylist())
                batch = batch.select([c for c in batch.schema.names if c not in (n_words, spans, items)])
            for d, (ranges, names) in hits.items():
                old[0][d], old[1][d] = _merge(old[0][d] + ranges), sorted({*old[1][d], *names})
            to = np.cumsum([0] + [len(x) for x in old[0]])
            flat = [x for row in old[0] for x in row]
            span_type = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.int32())], ["start", "stop"])
            names_to = np.cumsum([0] + [len(x) for x in old[1]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts.astype(np.int64)), list_array(span_type, to), list_array(pa.array([x for row in old[1] for x in row], pa.string()), names_to)],
                [*batch.schema.names, n_words, spans, items],
            )

    return run


def scan(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", part_windows: int = PART_WINDOWS) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, and their names: words, hit spans (word ranges, merged), items found."""
    n_words, spans, items = fresh(docs, "n_words"), fresh(docs, "hit_spans"), fresh(docs, "items")
    out, parts = docs, window_parts(bench, item_col, bench_text_col, part_windows)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{plain}, `{n_words}` long, `{spans}` array<struct<start:int,stop:int>>, `{items}` array<string>"
    for k, part in enumerate(parts):
        if k:
            out = materialize(out, "decontaminate-pass")
        out = out.mapInArrow(_scanner(part, text_col, n_words, spans, items, k == 0), schema)
    return out, n_words, spans, items


def report(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per document: words, hit words, hit spans, the items found and whether it is contaminated."""
    found, n_words, spans, items = scan(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), bench, text_col=text_col, **more)
    n_hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, s: acc + (s["stop"] - s["start"]).cast("long"))
    return found.select(
        F.col(id_col), F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.col(spans).alias("hit_spans"), F.col(items).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def _cut(text: str, spans: str, keep: list[str]):
    """Removes the bytes from a span's first word to its last word's end."""

    def run(batches):
        for batch, data, offs in sliced(batches, text):
            where = batch.column(spans).to_pylist()
            _, starts, ends, at = bt.words(data, offs)
            texts = batch.column(text).to_pylist()
            for i, cut in enumerate(where):
                if cut:
                    raw, pieces, last = data[offs[i] : offs[i + 1]].tobytes(), [], 0
                    for s in cut:
                        pieces.append(raw[last : starts[at[i] + s["start"]] - offs[i]])
                        last = ends[at[i] + s["stop"] - 1] - offs[i]
                    texts[i] = b"".join([*pieces, raw[last:]]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(c).type) if c == text else batch.column(c) for c in keep], keep)

    return run


def remove(docs: DataFrame, bench: DataFrame, *, how: str = "documents", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without contaminated documents, or (``how="spans"``) with their hit words cut out of the text."""
    if how not in ("documents", "spans"):
        raise ValueError("how is documents or spans")
    found, _, spans, _ = scan(docs, bench, text_col=text_col, **more)
    if how == "documents":
        return found.where(F.size(spans) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return found.mapInArrow(_cut(text_col, spans, docs.columns), docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's digest over all ``documents`` and the whole ``benchmark``."""
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(ws[k:k + size - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM b WHERE len(ws) > 0) x),
dw AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM bw) z WHERE len(ws) >= size) x),
h AS (SELECT dw.doc_id, dw.k, dw.size, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) x GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
