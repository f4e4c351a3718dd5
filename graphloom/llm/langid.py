"""Language identification with hashed subword embeddings.

A text's letters, lower-cased, give byte n-grams within words (their edges
marked); each is hashed to one of ``BUCKETS`` embeddings.  The mean embedding
goes through a linear softmax.  Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on at most about ``SAMPLE`` labelled
documents, whole (their ``MOST_SUBWORDS`` most frequent subwords), and a fragment
of each.

A fifth of these documents is held out.  It sets the softmax's temperature and
the rejection: a logistic model of the winner's odds and of how typical the
subwords are of its language (their mean log-frequency, also times the root of
their number) tells right predictions from wrong ones and from fragments whose
letters are exchanged or drawn at random.  What it calls right with a probability
of ``DOUBT`` is accepted, and so much more that at most ``MAY_LOSE`` of the right
ones are lost; ``false_accept`` is the share of the others that are accepted.

For prediction all linear maps are one table of a few numbers per bucket.

Defined cases: a text that is null or has no letter is ``und``, scores 0 and is
rejected; without labelled rows every text is; an empty table gives an empty
one; a very long text is read whole, as a slice of its own; equal texts and
repeated rows are predicted alike; extra columns are kept by ``keep_accepted``
and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytetext as bt
from graphloom.llm.common import list_array, logistic, sliced, table

BUCKETS = 1 << 14
DIM = 8
SIZES = (3, 4, 5)
SAMPLE = 2_000
#: Fragments have this length or that times 2, 4 or 8, in bytes.
FRAGMENT = 24
EPOCHS = 8
RATE = 40.0
#: Of a document that the model is fitted on, so many subwords count at most: 64 MB of features in all.
MOST_SUBWORDS = 4_096
#: Every so many-th document is held out.
HELD = 5
#: The share of right predictions on held-out rows that may fall below the rejection score.
MAY_LOSE = 0.001
#: What is right with this probability is accepted in any case.
DOUBT = 0.05
#: Words that no document has, for the frequency of unseen subwords.
UNSEEN = 1.0
SPACE = 0x20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts' subwords, and the text of each."""
    low = bt.LOWER[data]
    # capital Latin-1 letters in UTF-8: C3 80 to C3 9E but for 97
    lead = np.zeros(len(low), dtype=bool)
    lead[1:] = low[:-1] == 0xC3
    low[lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
    low[~_LETTER[low]] = SPACE
    lens = np.diff(offs)
    owner = np.repeat(np.arange(len(lens)), lens)
    padded = np.full(len(low) + len(lens) + 1, SPACE, dtype=np.uint8)
    padded[np.arange(len(low)) + owner + 1] = low
    text = np.zeros(len(padded), dtype=np.int32)
    text[np.arange(len(low)) + owner + 1] = owner
    solid = padded != SPACE
    wide = padded.astype(np.uint32)
    ids, owners = [], []
    for size in SIZES:
        n = len(padded) - size + 1
        if n <= 0:
            continue
        inner = solid[1 : 1 + n].copy()
        for t in range(2, size - 1):
            inner &= solid[t : t + n]
        at = np.flatnonzero(inner)
        gram = np.full(len(at), size, dtype=np.uint32)
        for t in range(size):
            gram = (gram ^ wide[at + t]) * np.uint32(0x01000193)
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        ids.append(gram >> np.uint32(32 - 14))
        owners.append(text[at + 1])
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(owners) if owners else np.zeros(0, np.int32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x 2 languages: embeddings times softmax weights, over the temperature, and log-frequencies
    weights: np.ndarray
    accept_from: float
    false_accept: float

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the likeliest language's number, its probability, whether the text has a letter, and whether it is accepted."""
        n, many = len(offs) - 1, len(self.langs)
        ids, owner = subwords(data, offs)
        count = np.bincount(owner, minlength=n)
        means = np.stack([np.bincount(owner, weights=self.table[ids, c], minlength=n) for c in range(2 * many)], axis=1) / np.maximum(count, 1)[:, None]
        p = softmax(means[:, :many])
        letters = np.concatenate(([0], np.cumsum(_LETTER[bt.LOWER[data]] & (data < 0x80))))
        has = letters[offs[1:]] > letters[offs[:-1]]
        for i in np.flatnonzero(~has & (count > 0)).tolist():
            has[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
        best = p.argmax(axis=1)
        score = p[np.arange(n), best]
        sure = evidence(score, means[np.arange(n), many + best], count) @ self.weights
        return best, score, has, has & (sure >= self.accept_from)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def evidence(score: np.ndarray, typical: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the rejection looks at: the winner's odds, and the mean log-frequency of the subwords, alone and with their number."""
    p = np.clip(score, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)), typical, np.clip(typical * np.sqrt(count) / 10, -10, 10)], axis=1)


def strange(data: np.ndarray, keys: np.ndarray, offs: np.ndarray, how: int) -> np.ndarray:
    """The texts with their letters exchanged by an alphabet that the key chooses (0), or drawn at random (1)."""
    out, letters = bt.LOWER[data], np.flatnonzero((bt.LOWER[data] >= 0x61) & (bt.LOWER[data] <= 0x7A))
    owner = np.repeat(keys.view(np.uint64), np.diff(offs))[letters]
    if how:
        out[letters] = 0x61 + (bt.mix64(letters.astype(np.uint64) ^ owner) % bt.U64(26)).astype(np.uint8)
        return out
    alphabets = np.stack([np.random.default_rng(k).permutation(26) for k in range(64)]).astype(np.uint8)
    out[letters] = 0x61 + alphabets[(owner % bt.U64(64)).astype(np.int64), out[letters] - 0x61]
    return out


def _counts(batches):
    """Sparse subword shares of each text (column 0) and of a fragment of it; column 1 is its label, 2 its hash.

    Parts: 0 the text, 1 a fragment, and of held-out documents 2 and 3 strange fragments.
    """
    for batch, data, offs in sliced(batches, 0):
        label, key = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        lens = np.diff(offs)
        # fragments of four lengths
        long = FRAGMENT << (bt.mix64(key.view(np.uint64), 1) % bt.U64(4)).astype(np.int64)
        begin = offs[:-1] + (key.view(np.uint64) % np.maximum(lens - long, 1).astype(np.uint64)).astype(np.int64)
        stop = np.minimum(begin + long, offs[1:])
        pieces = [data[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        cut, at = (np.concatenate(pieces) if pieces else data[:0]), np.concatenate(([0], np.cumsum(stop - begin)))
        held = _held(key)
        for part, d, o in ((0, data, offs), (1, cut, at), (2, strange(cut, key, at, 0), at), (3, strange(cut, key, at, 1), at)):
            ids, owner = subwords(d, o)
            both, n = np.unique(owner.astype(np.int64) * BUCKETS + ids, return_counts=True)
            own, total = both // BUCKETS, np.bincount(owner, minlength=len(lens))
            # the most frequent ones of each text
            order = np.lexsort((both, -n, own))
            place = np.arange(len(order)) - np.searchsorted(own, own)
            keep = np.sort(order[place < MOST_SUBWORDS])
            keep = keep[held[own[keep]]] if part > 1 else keep
            both, n, own = both[keep], n[keep], own[keep]
            to = np.searchsorted(own, np.arange(len(lens) + 1))
            share = (n / np.maximum(total, 1)[own]).astype(np.float32)
            cols = [pa.array(label, pa.string()), pa.array(key), pa.array(np.full(len(lens), part, np.int32)), pa.array(total.astype(np.int32)), list_array(pa.array((both % BUCKETS).astype(np.int32)), to), list_array(pa.array(share), to)]
            yield pa.RecordBatch.from_arrays(cols, ["label", "key", "part", "n", "ids", "shares"])


def _held(key: np.ndarray) -> np.ndarray:
    """Whether a document is held out of the training, by its hash."""
    return bt.mix64(key.view(np.uint64), 2) % bt.U64(HELD) == 0


Row = tuple[str, int, int, int, np.ndarray, np.ndarray]  # label, hash, part, subwords, buckets, shares


def fit(rows: list[Row], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model | None:
    """Trains on the texts and fragments that aren't held out; the others set temperature and rejection."""
    rows = [r for r in rows if len(r[4])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    out = _held(np.array([r[1] for r in rows], dtype=np.int64)).tolist()
    train, held = [r for r, h in zip(rows, out, strict=True) if not h and r[2] < 2], [r for r, h in zip(rows, out, strict=True) if h]
    # a table of a few documents has none to hold out, or only such
    train = train or [r for r in held if r[2] < 2]
    held = held if any(r[2] < 2 for r in held) else [*held, *train]
    emb, soft = np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 1, (len(langs), DIM)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(train)).tolist():
            label, _, _, _, ids, shares = train[i]
            hidden = shares @ emb[ids]
            z = soft @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[label]] -= 1
            back = p @ soft
            soft -= np.float32(step * 0.01) * np.outer(p, hidden)
            emb[ids] -= np.float32(step) * np.outer(shares, back)
    often, docs = np.full((len(langs), BUCKETS), UNSEEN / BUCKETS), np.full((len(langs), 1), UNSEEN)
    for label, _, _, _, ids, shares in train:
        often[number[label], ids] += shares
        docs[number[label]] += 1
    flat, typical = emb @ soft.T, np.log(often / docs * BUCKETS).T
    real = np.array([r[2] < 2 for r in held])
    truth = np.array([number[r[0]] for r in held])
    logits = np.stack([r[5] @ flat[r[4]] for r in held])
    scale = min(np.geomspace(0.1, 10, 41).tolist(), key=lambda s: -np.log(np.maximum(softmax(logits[real] * s)[np.arange(real.sum()), truth[real]], 1e-12)).mean())
    p = softmax(logits * scale)
    best = p.argmax(axis=1)
    seen = np.array([r[5] @ typical[r[4], b] for r, b in zip(held, best.tolist(), strict=True)])
    x, right = evidence(p.max(axis=1), seen, np.array([r[3] for r in held])), real & (best == truth)
    if not right.any():
        return Model(langs, np.concatenate([flat * scale, typical], axis=1).astype(np.float32), np.array([1.0, 0, 0, 0]), 0.0, 1.0)
    weights = logistic(x, right.astype(float))
    sure = x @ weights
    # what may well be right is accepted in any case
    accept = min(float(np.log(DOUBT / (1 - DOUBT))), float(np.quantile(sure[right], MAY_LOSE)))
    return Model(langs, np.concatenate([flat * scale, typical], axis=1).astype(np.float32), weights, accept, float((sure[~right] >= accept).mean()) if (~right).any() else 0.0)


def fit_documents(docs: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Trains on about ``sample`` usable rows at most, chosen by a hash of the id: a bounded sample of labelled rows."""
    key = F.xxhash64(F.lit(7), F.col(id_col).cast("string"))
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.select(F.lit(1)).count()
    share = 1.0 if total <= sample else sample / total
    chosen = rows.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    made = chosen.select(F.col(text_col).cast("string"), F.col(label_col).cast("string"), key.alias("key")).mapInArrow(_counts, "label string, key long, part int, n int, ids array<int>, shares array<float>").toArrow()
    made = made.sort_by([("key", "ascending"), ("part", "ascending")])
    ids, shares = made["ids"].combine_chunks(), made["shares"].combine_chunks()
    plain = zip(*(made[c].to_pylist() for c in ("label", "key", "part", "n")), strict=True)
    return fit([(*row, ids[i].values.to_numpy(), shares[i].values.to_numpy()) for i, row in enumerate(plain)])


def _predict(model: Model | None, names: tuple[str, ...]):
    """Adds the language, the score and whether it is rejected; the text is the last column, and isn't returned."""

    def run(batches):
        for batch, data, offs in sliced(batches, len(names)):
            n = batch.num_rows
            if model is None:
                lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
            else:
                best, score, has, accepted = model.predict(data, offs)
                lang = [model.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has, score, 0.0)
                rejected = ~accepted
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``lang_pred``, ``score`` and ``rejected``."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(_predict(model, ("id",)), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""

    def run(batches):
        for batch, data, offs in sliced(batches, text_col):
            if model is None:
                continue
            yield batch.filter(pa.array(model.predict(data, offs)[3]))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id reads as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learnt from those whose remainder is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit_documents(docs, remainder("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
