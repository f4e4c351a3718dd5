"""Toxicity as maximum-scoring segments.

A token's log-odds (toxic against other documents) come from its document
counts with Dirichlet priors in a chain: the prior of a word of ``PRIOR``
documents has the share of toxic ones that its first six bytes have, theirs that
of the first four, and theirs that of all documents.  So a rare form of a known
stem scores like the stem, and what is rare altogether like nothing.  The
log-odds shrink by ``SHRINK`` standard errors, and a drift makes the mean
negative.  A linear-time scan finds every maximal scoring segment of a text.

The best segment of clean text follows an extreme-value law: of n tokens it
stays below S with probability exp(-K n e^(-lambda S)).  Lambda and K are fitted
by maximum likelihood to the best segments of held-back clean documents.  A
segment's statistic is lambda S - ln(K n); those with an expectation below
``EXPECT`` are toxic passages.  Two numbers of each text, the best segment's
statistic and the sum of the significant ones', give the calibrated score.

The model is fitted on a bounded sample of at most ``SAMPLE`` labelled rows:
two thirds give the log-odds, one third the calibration.  Tokens and prefixes
are hashed to ``BUCKETS`` counts each, so the model's size has a bound whatever
the vocabulary.

Defined cases: a null or empty text has no segments and gets the score of a
text without evidence; without labelled rows of both kinds every score is 0;
of repeated labels of an id the largest counts; equal texts and repeated rows
score alike; an empty table gives an empty one; a very long text is read whole,
as a slice of its own; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import list_array, logistic, sliced, table
from graphloom.llm.langid import remainder

BUCKETS = 1 << 20
#: Below 2^16, which holds the counts.
SAMPLE = 40_000
#: Documents that the prior adds to each token's counts.
PRIOR = 16.0
#: Bytes of a word that are counted together, and the whole word.
PREFIXES = (4, 6, 1 << 40)
#: Standard errors that the log-odds shrink by.
SHRINK = 1.5
DRIFT = 0.5
LEAST, MOST = -2.0, 8.0
EXPECT = 0.01
#: Lambda and K where no clean document has a positive segment.
LAMBDA, K = 1.0, 0.01


def token_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' prefixes and of the words, a row each, and the texts' word offsets."""
    low = bt.LOWER[data]
    starts, ends, at = bt.runs(bt.WORD[low], offs)
    rows = [(bt.span_hashes(low, starts, np.minimum(ends, starts + size), seed=10 + k) >> bt.U64(44)).astype(np.int64) for k, size in enumerate(PREFIXES)]
    return np.stack(rows), at


def _document_counts(batches):
    """(bucket, other documents, toxic documents) of a partition; column 0 is the text, 1 the label."""
    size = BUCKETS * len(PREFIXES)
    counts = np.zeros((2, size), dtype=np.int64)
    for batch, data, offs in sliced(batches, 0):
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, at = token_buckets(data, offs)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        for k, row in enumerate(rows):
            both = np.unique(doc * BUCKETS + row)
            for y in (0, 1):
                counts[y, k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(both[label[both // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(used), 50_000):
        part = used[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], ["bucket", "other", "toxic"])


def token_scores(other: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Shrunk log-odds of tokens, less the drift; rows are the counts of their prefixes, and the last one their own."""
    theta = np.full(other.shape[1], share)
    for n0, n1 in zip(other.astype(np.float64), toxic.astype(np.float64), strict=True):
        yes, no = n1 + PRIOR * theta, n0 + PRIOR * (1 - theta)
        theta = yes / (yes + no)
    odds = np.log(theta / (1 - theta)) - np.log(share / (1 - share))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - SHRINK * np.sqrt(1 / yes + 1 / no), 0)
    return np.clip(odds, LEAST, MOST) - DRIFT


def fit_extremes(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Lambda and K by maximum likelihood, from the best segments' scores (0 for none) and the numbers of words of clean texts."""
    some = best > 0
    if not some.any():
        return LAMBDA, K
    n = np.maximum(words, 1).astype(np.float64)

    def at(lam: float) -> tuple[float, float, float]:
        # for a given lambda the best K is known
        k = some.sum() / (n @ np.exp(-lam * best))
        return some.sum() * (np.log(k) + np.log(lam)) - lam * best.sum(), lam, k

    _, lam, k = max(at(x) for x in np.geomspace(0.05, 20, 400).tolist())
    return lam, k


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), from left to right, in linear time.

    Runs of positive scores are taken as one, since no maximal segment begins
    or ends inside one; the stack holds candidates with the sums before and
    after them, and a pointer to the nearest earlier one with a smaller sum.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    stack: list[tuple[int, int, float, float, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        start, left, right = a, sums[a], sums[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, b, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in stack]


@dataclass
class Model:
    other: np.ndarray  # documents that have each prefix or word, by bucket
    toxic: np.ndarray
    share: float
    lam: float
    k: float
    weights: np.ndarray  # of 1, the best statistic and the significant sum

    def segments(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: its number of words, and its maximal segments."""
        rows, at = token_buckets(data, offs)
        flat = rows + np.arange(len(PREFIXES))[:, None] * BUCKETS
        s = token_scores(self.other[flat], self.toxic[flat], self.share)
        n = len(offs) - 1
        found: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        positive = np.concatenate(([0], np.cumsum(s > 0)))
        for i in np.flatnonzero(positive[at[1:]] > positive[at[:-1]]).tolist():
            found[i] = maximal_segments(s[at[i] : at[i + 1]])
        return np.diff(at), found

    def evidence(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: the best segment's statistic, the sum of the significant ones', and the passages."""
        words, found = self.segments(data, offs)
        floor = -np.log(self.k * np.maximum(words, 1))
        best, total = floor.copy(), np.zeros(len(words))
        passages: list[list[tuple[int, int, float]]] = []
        for i, own in enumerate(found):
            stats = [(a, b, self.lam * x + floor[i]) for a, b, x in own]
            best[i] = max([best[i], *(x for _, _, x in stats)])
            passages.append([x for x in stats if x[2] > -np.log(EXPECT)])
            total[i] = sum(x for _, _, x in passages[-1])
        return best, total, passages

    def probability(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(best, total) @ self.weights, -30, 30)))


def _inputs(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.clip(best, -10, 30) / 10, np.log1p(total)], axis=1)


def _best(model: Model):
    """(label, words, best segment's score) of each text; column 0 is the label, 1 the text."""

    def run(batches):
        for batch, data, offs in sliced(batches, 1):
            words, found = model.segments(data, offs)
            best = [max((x for _, _, x in own), default=0.0) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(best, pa.float64())], ["key", "words", "best"])

    return run


def _evidence(model: Model, id_first: bool):
    """Evidence of each text; column 0 is the label or id, 1 the text."""

    def run(batches):
        for batch, data, offs in sliced(batches, 1):
            best, total, passages = model.evidence(data, offs)
            cols, names = [batch.column(0), pa.array(best), pa.array(total)], ["key", "best", "total"]
            if id_first:
                flat = [x for own in passages for x in own]
                parts = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.float64())], ["start", "stop", "statistic"])
                cols = [batch.column(0), pa.array(model.probability(best, total)), list_array(parts, np.cumsum([0] + [len(x) for x in passages]))]
                names = ["key", "score", "passages"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def fit_documents(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fits on a sample of labelled rows, of ``sample`` rows at most, chosen by a hash of the id.

    The sample's ids and labels, two numbers a row, are broadcast; the bound is
    the parameter's.
    """
    key = F.xxhash64(F.lit(3), F.col(id_col).cast("string"))
    chosen = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(3), F.col("_of").cast("string")), "_of").limit(sample)
    joined = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_of"))
    learn = F.pmod(key, F.lit(3)) != 0
    got = joined.where(learn).select("text", "_label").mapInArrow(_document_counts, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    other, toxic = (np.zeros(BUCKETS * len(PREFIXES), np.uint16) for _ in range(2))
    at = got["bucket"].to_numpy()
    other[at], toxic[at] = (np.minimum(got[c].to_numpy(), (1 << 16) - 1) for c in ("other", "toxic"))
    counts = {r["_label"]: r["n"] for r in chosen.where(F.pmod(F.xxhash64(F.lit(3), F.col("_of").cast("string")), F.lit(3)) != 0).groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not other.any() or not toxic.any():
        return None
    model = Model(other, toxic, counts[1] / (counts[0] + counts[1]), LAMBDA, K, np.zeros(3))
    back = joined.where(~learn).select("_label", "text")
    first = back.mapInArrow(_broadcast(docs, model, _best), "key int, words long, best double").toArrow()
    clean = first["key"].to_numpy() == 0
    model.lam, model.k = fit_extremes(first["best"].to_numpy()[clean], first["words"].to_numpy()[clean])
    rows = back.mapInArrow(_broadcast(docs, model, lambda m: _evidence(m, False)), "key int, best double, total double").toArrow()
    y = rows["key"].to_numpy().astype(float)
    if not len(y):
        return None
    model.weights = logistic(_inputs(rows["best"].to_numpy(), rows["total"].to_numpy()), y)
    return model


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``score`` and the toxic ``passages`` (word ranges with their statistic)."""
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,stop:int,statistic:double>>").alias("passages"))
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kinds = f"key {kind}, score double, passages array<struct<start:int,stop:int,statistic:double>>"
    return out.mapInArrow(_broadcast(docs, model, lambda m: _evidence(m, True)), kinds).withColumnRenamed("key", id_col)


def _broadcast(docs: DataFrame, model: Model, use):
    """The function that ``use`` makes of the model, which is broadcast: 12 MB at most."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return lambda batches: use(held.value)(batches)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all ``documents``, learnt from labels whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    out = score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
