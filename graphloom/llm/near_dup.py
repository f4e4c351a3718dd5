"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of five-word shingles.  Texts of one set are one class, and
only classes are joined.  MinHash values in bands propose candidates; a pair is
looked at in its first common band only.  Its values are compared 16 at a time,
and it is dropped once the posterior probability of a similarity of 0.8 falls
below ``TOLERANCE`` (uniform prior).  What is left is verified on the words of the
shingles, not on hashes.  A class is told by 128 bits, whose halves come from
independent hashes of the shingles.

No pair is ever a row.  A band's bucket is worked on in blocks of about
``BLOCK`` classes, two blocks at a time; of each, only link counts and a
spanning forest come out.  First the signatures alone tell which classes have
candidates; only their texts are shuffled.

With 24 bands of 4 values a pair at 0.8 is missed with a probability of 3e-6,
and lost to pruning with 9e-6 at most; more similar pairs with less.

Defined cases: a text of fewer than five words, but not none, has one shingle,
all its words; a text without words has no links and is its own class; rows of
one id are counted one by one; rows without an id count as partners, and their
class has the least id there is, or null; an empty table gives an empty one; a
very long text is one slice of its own and is read whole; extra columns are kept
by ``keep_one`` and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import fresh, grouped, materialize, sliced, table
from graphloom.llm.components import components

SHINGLE = 5
#: Seed of the second hash in class keys.
SECOND = 77
THRESHOLD = (4, 5)  # 0.8 as a fraction
VALUES, ROWS, STEP = 96, 4, 16
BANDS = VALUES // ROWS
TOLERANCE = 1e-6
BLOCK = 512
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, another hash of each of them, and the texts' offsets."""
    hashes, _, _, at = bt.words(data, offs)
    windows, to = bt.text_windows(hashes, at, SHINGLE)
    others, _ = bt.text_windows(bt.words(data, offs, seed=SECOND)[0], at, SHINGLE)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(to))
    order = np.lexsort((windows, doc))
    windows, others, doc = windows[order], others[order], doc[order]
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (windows[1:] != windows[:-1]) | (doc[1:] != doc[:-1])
    return windows[new], others[new], np.searchsorted(doc[new], np.arange(len(offs)))


def spelled_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers; equal numbers are equal words in equal order."""
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    low = bt.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, at = bt.runs(bt.WORD[low], offs)
    number = np.append(bt.span_numbers(low, starts, ends) + 1, 0)
    counts = np.diff(at)
    windows = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(texts)), windows)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    key, many = np.zeros(len(doc), np.int64), int(number.max()) + 1
    for t in range(SHINGLE):
        # 0 stands for no word, in texts of fewer words
        word = np.where(first + t < at[1:][doc], number[np.minimum(first + t, len(number) - 1)], 0)
        _, key = np.unique(key * many + word, return_inverse=True)
    both = np.unique(doc * (int(key.max()) + 1 if len(key) else 1) + key)
    cut = np.searchsorted(both, np.arange(len(texts) + 1) * (int(key.max()) + 1 if len(key) else 1))
    return [both[a:b] - k * (int(key.max()) + 1) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))] if len(key) else [both for _ in texts]


def set_keys(values: np.ndarray, others: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 128-bit key of each non-empty set, as rows of 16 bytes; its halves come from independent hashes of the shingles."""
    out = np.stack([np.add.reduceat(bt.mix64(v, seed), to) for seed, v in ((1, values), (2, others))], axis=1)
    return np.ascontiguousarray(out.astype(">u8")).view(np.uint8).reshape(len(to), 16)


def signatures(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty set."""
    x = (values >> bt.U64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(x * a + b, to) for a, b in zip(_FACTORS, _TERMS, strict=True)], axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1].tobytes() if width else bytes(4 * (n + 1))), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    data, _ = bt.column_bytes(column)
    return data.copy().view(kind).reshape(-1, width)


def _sign(batches):
    """(id, class key, shingles, signature) of each text with words; column 0 is the id, 1 the text."""
    for batch, data, offs in sliced(batches, 1):
        values, others, to = shingle_sets(data, offs)
        full = np.flatnonzero(np.diff(to))
        if len(full):
            at = to[full]
            signs = signatures(values, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), _binary(set_keys(values, others, at)), pa.array(np.diff(to)[full].astype(np.int32)), _binary(signs.view(np.uint8))], ["id", "ck", "n", "sig"])


def _band_rows(batches):
    for batch in batches:
        if batch.num_rows:
            signs = _matrix(batch.column(1), np.uint32, VALUES).astype(np.uint64)
            for band in range(BANDS):
                key = bt.window_hashes(signs[:, band * ROWS : (band + 1) * ROWS].ravel(), ROWS)[::ROWS]
                yield pa.RecordBatch.from_arrays([pa.array((bt.mix64(key, band) & bt.U64(0xFFFFFFFFFFFFFFE0) | bt.U64(band)).view(np.int64)), batch.column(0)], ["bucket", "ck"])


def fewest_matches() -> np.ndarray:
    """After 16, 32, ... values: the fewest matches that leave the posterior above the tolerance."""
    t, out = THRESHOLD[0] / THRESHOLD[1], []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, 0
        # P(J >= t | m of n) under a uniform prior is P(Bin(n + 1, t) <= m)
        while (total := total + math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < TOLERANCE:
            m += 1
        out.append(m)
    return np.array(out)


_FEWEST = fewest_matches()


def candidates(signs: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket whose first common band this is and which the posterior keeps."""
    left, right = [], []
    n = len(signs)
    step = max(1, (1 << 16) // max(n, 1))
    for a in range(0, n, step):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(a, min(a + step, n)), np.arange(n), indexing="ij"))
        keep = (i < j) if same else (blocks[i] < blocks[j])
        keep &= np.minimum(sizes[i], sizes[j]) * THRESHOLD[1] >= np.maximum(sizes[i], sizes[j]) * THRESHOLD[0]
        i, j = i[keep], j[keep]
        matches = np.zeros(len(i), dtype=np.int64)
        for s in range(0, VALUES, STEP):
            equal = signs[i, s : s + STEP] == signs[j, s : s + STEP]
            whole = equal.reshape(-1, STEP // ROWS, ROWS).all(axis=2)
            matches += equal.sum(axis=1)
            keep = matches >= _FEWEST[s // STEP]
            first = s // ROWS
            earlier = min(max(band - first, 0), STEP // ROWS)
            keep &= ~whole[:, :earlier].any(axis=1)
            if first <= band < first + STEP // ROWS:
                keep &= whole[:, band - first]
            i, j, matches = i[keep], j[keep], matches[keep]
        left.append(i)
        right.append(j)
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


_GROUP = ["bucket", "bi", "bj"]


def _groups(batches):
    """Each group's table, bucket's band, whether it is one block with itself, and signatures, sizes, blocks; once for each class."""
    for t, at in grouped(batches, _GROUP):
        bucket, bi, bj = (t[c].to_numpy() for c in _GROUP)
        signs, sizes, blocks = _matrix(t["sig"].combine_chunks(), np.uint32, VALUES), t["n"].to_numpy().astype(np.int64), t["blk"].to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield t, a, b, int(bucket[a]) & 31, bi[a] == bj[a], signs[a:b], sizes[a:b], blocks[a:b]


def _involved(batches):
    """The classes of each group that have a candidate there."""
    rows: list[pa.Table] = []
    for t, a, _, band, same, signs, sizes, blocks in _groups(batches):
        i, j = candidates(signs, sizes, blocks, band, same)
        if len(i):
            rows.append(t.select([*_GROUP, "ck", "blk"]).take(pa.array(a + np.unique(np.concatenate((i, j))))))
        if len(rows) >= 500:
            yield from pa.concat_tables(rows).combine_chunks().to_batches()
            rows = []
    if rows:
        yield from pa.concat_tables(rows).combine_chunks().to_batches()


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sorted sets."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    twice = count[value] > 1
    owner, value = owner[twice], np.cumsum(np.diff(value[twice], prepend=-1) != 0) - 1
    inter, width = np.zeros((len(sets), len(sets)), np.float32), 2048
    for c in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        a, b = np.searchsorted(value, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], value[a:b] - c] = 1
        inter += x @ x.T
    return np.rint(inter[i, j]).astype(np.int64)


def _verify(batches):
    """(class, documents linked, root) of each group's verified pairs: the root spans the group's components."""
    for t, a, b, band, same, signs, sizes, blocks in _groups(batches):
        keys = t["ck"].slice(a, b - a).to_pylist()
        one = np.unique(np.array(keys, dtype=object).astype("S16") if keys else np.zeros(0, "S16"), return_index=True)[1]
        one.sort()
        signs, sizes, blocks, keys = signs[one], sizes[one], blocks[one], [keys[k] for k in one.tolist()]
        i, j = candidates(signs, sizes, blocks, band, same)
        if not len(i):
            continue
        # the words themselves are compared, of the texts that are in a pair
        used, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
        raw, docs = t["text"].slice(a, b - a), t["docs"].to_numpy()[a:b][one]
        sets = spelled_sets([raw[int(k)].as_py() for k in one[used]])
        sizes[used] = [len(x) for x in sets]
        inter = shared_counts(sets, flat[: len(i)], flat[len(i) :])
        near = inter * THRESHOLD[1] >= (sizes[i] + sizes[j] - inter) * THRESHOLD[0]
        i, j = i[near], j[near]
        links = np.bincount(i, weights=docs[j], minlength=len(keys)) + np.bincount(j, weights=docs[i], minlength=len(keys))
        root = np.arange(len(keys))
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        used = np.flatnonzero(links)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in used.tolist()], pa.binary()), pa.array(links[used].astype(np.int64)), pa.array([keys[k] for k in root[used].tolist()], pa.binary())], ["ck", "links", "root"])


def _marked(words: np.ndarray, bits: int):
    """(class key, id, text) of the texts whose id's hash is marked; columns: id, text, hash."""

    def run(batches):
        for batch in batches:
            place = batch.column(2).to_numpy().view(np.uint64) & bt.U64(bits - 1)
            hit = (words[place >> bt.U64(6)] >> (place & bt.U64(63)) & bt.U64(1)).astype(bool)
            for part, data, offs in sliced([batch.filter(pa.array(hit))], 1):
                values, others, to = shingle_sets(data, offs)
                full = np.flatnonzero(np.diff(to))
                if len(full):
                    keys = set_keys(values, others, to[full])
                    texts = pa.array([data[offs[k] : offs[k + 1]].tobytes() for k in full.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([_binary(keys), part.column(0).take(pa.array(full)), texts], ["ck", "id", "text"])

    return run


def _marks(ids: DataFrame, col: str) -> tuple[np.ndarray, int]:
    """A filter of the ids' hashes: at most ``MOST_BITS`` bits, so its size has a bound."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (ids.count() * 16).bit_length()))
    place = F.xxhash64(col).bitwiseAND(F.lit(bits - 1))
    got = ids.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words, bits


def _blocked(rows: DataFrame) -> DataFrame:
    """One row for each two blocks of a bucket that the class takes part in."""
    parts = F.ceil(F.col("members") / F.lit(BLOCK))
    out = rows.withColumn("blk", F.pmod(F.xxhash64("ck"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return out.select("bucket", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "ck")


class Join:
    """``members`` (id, class key), ``classes`` (class key, least id, documents) and ``verified`` (class key, links, root)."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
        self.id_col = id_col
        kind = docs.schema[id_col].dataType.simpleString()
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        signed = materialize(texts.mapInArrow(_sign, f"id {kind}, ck binary, n int, sig binary"), "near-signed")
        self.members = signed.select("id", "ck")
        self.classes = materialize(signed.groupBy("ck").agg(F.min("id").alias("rep"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-classes")
        bands = self.classes.select("ck", "sig").mapInArrow(_band_rows, "bucket long, ck binary")
        full = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
        rows = _blocked(bands.join(full, "bucket"))
        own = self.classes.select("ck", "n", "sig")
        work = rows.join(own, "ck").select(*_GROUP, "blk", "ck", "n", "sig").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        involved = materialize(work.mapInArrow(_involved, "bucket long, bi long, bj long, ck binary, blk long"), "near-involved")
        needed = materialize(involved.select("ck").distinct().join(self.classes, "ck"), "near-needed")
        words, bits = _marks(needed, "rep")
        held = docs.sparkSession.sparkContext.broadcast(words)
        spelled = texts.select("id", "text", F.xxhash64("id").alias("hash")).mapInArrow(_late(held, bits), f"ck binary, id {kind}, text binary")
        chosen = needed.join(spelled.select(F.col("ck").alias("of"), "id", "text"), (F.col("ck") == F.col("of")) & F.col("rep").eqNullSafe(F.col("id"))).select("ck", "docs", "n", "sig", "text")
        again = involved.join(chosen, "ck").select(*_GROUP, "blk", "ck", "docs", "n", "sig", "text").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        self.verified = materialize(again.mapInArrow(_verify, "ck binary, links long, root binary"), "near-verified")

    def result(self) -> DataFrame:
        """Per row with words: id, ``class_id`` (the least id of the texts that links join), ``copy_id`` (of equal sets), ``n_links``."""
        labels = components(self.verified, "ck", "root").select(F.col("node").alias("ck"), "label")
        joined = self.classes.select("ck", "rep", "docs").join(labels, "ck", "left").withColumn("label", F.coalesce("label", "ck"))
        least = labels.join(self.classes.select("ck", "rep"), "ck").groupBy("label").agg(F.min("rep").alias("least"))
        links = self.verified.groupBy("ck").agg(F.sum("links").alias("links"))
        info = joined.join(least, "label", "left").join(links, "ck", "left").select("ck", F.coalesce("least", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
        return self.members.join(info, "ck").select("id", "class_id", "copy_id", "n_links")


def _late(held, bits: int):
    return lambda batches: _marked(held.value, bits)(batches)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``class_id``, ``copy_id`` and ``n_links``, the number of other rows with a similarity of 0.8 or more."""
    found = Join(docs, id_col=id_col, text_col=text_col).result()
    # texts without words have no shingles, so they aren't in the result yet
    letters = F.col(text_col).cast("string").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    bare = docs.where(~F.coalesce(letters, F.lit(False))).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"), F.col(id_col).alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(bare).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the least id of each class only; rows without an id stay, and rows of one id that stays do."""
    # read four times below
    found = materialize(Join(docs, id_col=id_col, text_col=text_col).result(), "near-found")
    kept = found.where(F.col("id") == F.col("class_id")).select(F.col("id").alias("_kept"))
    name = fresh(docs, "_gone")
    gone = found.where(F.col("id") != F.col("class_id")).select(F.col("id").alias(name)).join(kept, F.col(name) == F.col("_kept"), "left_anti").distinct()
    out = docs.join(materialize(gone, "near-gone").hint("shuffle_hash"), docs[id_col] == F.col(name), "left_anti")
    repeated = found.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return out
    # only rows of the repeated ids are held against each other
    name = fresh(docs, "_again")
    again = materialize(repeated.select(F.col("id").alias(name)), "near-again").hint("shuffle_hash")
    twice = out.join(again, docs[id_col] == F.col(name), "left_semi").dropDuplicates([id_col, text_col])
    return out.join(again, docs[id_col] == F.col(name), "left_anti").union(twice)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle is counted, and components are walked: for small tables.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM d WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y, shared = nx.n AND shared = ny.n AS same FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * shared >= 4 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT x, count(*) AS n_links, min(y) FILTER (same) AS copy FROM e GROUP BY x)
SELECT c.doc_id, c.class_id, least(c.doc_id, coalesce(l.copy, c.doc_id)) AS copy_id, coalesce(l.n_links, 0) AS n_links FROM c LEFT JOIN l ON l.x = c.doc_id
"""
