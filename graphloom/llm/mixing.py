"""Mixing sources to target weights.

The words of each source are one stream, in chunks by document hash, packed
into blocks of ``BLOCK`` words (the last one is shorter).  A source's target
gives its number of slots; each output shard draws its source counts from the
multinomial, given the sources' totals: first groups of shards, then the shards
of a group, both in tasks.  Slots are numbered within their source, mapped to
blocks through a pseudorandom permutation of the block numbers, one for each
pass over the source, and joined to the blocks by that number.  A source's last
slot is cut to length, so it gives its target to the word.

The driver holds one row for each source, ``MOST_SOURCES`` at most (some 100 MB);
it refuses more.  Shards have no bound.

Defined cases: a null or blank text has no words and gives none; null is a
source, the last; a source without words has the target 0; rows of one id are
separate documents of the stream, and of equal rows it isn't told which is
which; an empty table gives an empty one; a very long text is counted whole; no
document is taken more than twice; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm import bytetext as bt
from graphloom.llm.common import materialize, table

BLOCK = 256
SHARD_SLOTS = 4096
#: A task makes about so many slots.
TASK_SLOTS = 50_000
#: Partitions of the slots at most: beyond, a task makes more slots, one after the other.
MOST_TASKS = 20_000
#: Shards that are drawn together.
GROUP_SHARDS = 8
MOST_SOURCES = 500_000
#: A chunk has about 4 sqrt(documents), so chunks are as many as their size allows to add up in one window.
LEAST_CHUNK_DOCS = 1_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = 20_240_501


def water_fill(sizes: list[int], weights: list[float], share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes; what is above a ceiling is shared anew among the rest."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / weight > ceiling * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = ceiling * sizes[i]
        open_ -= set(over)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1: a four-round Feistel network that walks until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = bt.U64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bt.U64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (bt.mix64(right, key * 4 + r) & mask)
        return left << bt.U64(half) | right

    out = once(k.astype(np.uint64))
    while (outside := out >= bt.U64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slot_plan(size: int, target: int, block: int = BLOCK) -> tuple[int, int, int, int]:
    """Full blocks, blocks, slots and the words of the last slot, for a source of ``size`` words."""
    full = size // block
    blocks = full + (size % block > 0)
    passes, rest = divmod(target, size) if size else (0, 0)
    some = min(rest // block, full)
    last = rest - some * block
    return full, blocks, passes * blocks + some + (last > 0), last


def _draws(shards: int, seed: int):
    """The slots that groups of shards draw of each source: rows of the source, the group, the first slot's number and how many."""

    def run(batches):
        groups = -(-shards // GROUP_SHARDS)
        sizes = np.full(groups, GROUP_SHARDS)
        sizes[-1] = shards - GROUP_SHARDS * (groups - 1)
        for batch in batches:
            for r in batch.to_pylist():
                drawn = np.random.default_rng([seed, r["sidx"]]).multinomial(r["slots"], sizes / shards)
                first = np.cumsum(drawn) - drawn
                some = np.flatnonzero(drawn)
                for k in range(0, len(some), 1 << 14):
                    part = some[k : k + (1 << 14)]
                    plan = [pa.array(np.full(len(part), r[c], np.int64)) for c in _PLAN]
                    yield pa.RecordBatch.from_arrays([*plan, *(pa.array(x.astype(np.int64)) for x in (part, sizes[part], first[part], drawn[part]))], [*_PLAN, "group", "shards", "first", "n"])

    return run


_PLAN = ("sidx", "size", "full", "blocks", "slots", "last")


def _slots(block: int, seed: int):
    """The slots of each (source, group) row: shard, epoch, block number, words, and an order within the shard."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                drawn = np.random.default_rng([seed, r["sidx"], r["group"]]).multinomial(r["n"], np.full(r["shards"], 1 / r["shards"]))
                ends = r["first"] + np.cumsum(drawn)
                for begin in range(r["first"], r["first"] + r["n"], 1 << 16):
                    j = np.arange(begin, min(begin + (1 << 16), r["first"] + r["n"]))
                    shard = r["group"] * GROUP_SHARDS + np.searchsorted(ends, j, side="right")
                    epoch, k = j // r["blocks"], j % r["blocks"]
                    number = k.copy()
                    for e in np.unique(epoch).tolist():
                        own = (epoch == e) & (k < r["full"])
                        number[own] = permute(k[own], r["full"], seed + 1009 * r["sidx"] + e)
                    words = np.where(number < r["full"], block, r["size"] - r["full"] * block)
                    if r["last"]:
                        words[j == r["slots"] - 1] = r["last"]
                    order = bt.mix64(j.astype(np.uint64), seed + r["sidx"]).view(np.int64)
                    ones = np.ones(len(j), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ones * r["sidx"], shard, order, epoch, number, words)], ["sidx", "shard", "position", "epoch", "block", "words"])

    return run


class Mix:
    """The plan of a mix: ``documents`` (with stream places), ``sources`` (with targets), ``slots``."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS):
        spark = docs.sparkSession
        self.block, self.id_col = block, id_col
        size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        # a hash of the text spreads the rows of a null or repeated id
        some = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(id_col, text_col).alias("hash"))
        base = materialize(some, "mix-sizes")
        # one row for each source: the only thing that comes to the driver
        found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"there are more than {MOST_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        targets = water_fill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
        self.sources = [(i, r["source"], r["size"], t) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
        docs_in_all = sum(r["docs"] for r in found)
        chunks = max(1, -(-docs_in_all // max(LEAST_CHUNK_DOCS, 4 * math.isqrt(docs_in_all))))
        frame = spark.createDataFrame(self.sources, T.StructType([T.StructField("sidx", T.LongType()), T.StructField("named", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
        placed = base.join(frame, F.col("source").eqNullSafe(F.col("named"))).withColumn("chunk", F.pmod("hash", F.lit(chunks)))
        order = Window.partitionBy("sidx", "chunk").orderBy("id", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
        # the offsets of chunks: one row for each source and chunk
        sums = placed.groupBy("sidx", "chunk").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(F.col("sidx").alias("of"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        placed = placed.join(starts, (F.col("sidx") == F.col("of")) & (F.col("chunk") == F.col("of_chunk")))
        self.documents = materialize(placed.select("id", "sidx", "source", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("start")), "mix-documents")
        plans = [(i, n, *slot_plan(n, math.floor(t), block)) for i, _, n, t in self.sources]
        slots = sum(p[4] for p in plans)
        shards = max(1, -(-slots // shard_slots))
        frame = spark.createDataFrame([p for p in plans if p[4]], ", ".join(f"{n} long" for n in _PLAN))
        groups = frame.mapInArrow(_draws(shards, seed), ", ".join(f"{n} long" for n in (*_PLAN, "group", "shards", "first", "n")))
        # a fixed number: the rows are few, and adaptive execution would make one task of them
        tasks = min(MOST_TASKS, max(1, -(-slots // TASK_SLOTS)))
        self.slots = groups.repartition(tasks, "sidx", "group").mapInArrow(_slots(block, seed), "sidx long, shard long, position long, epoch long, block long, words long")

    def pieces(self) -> DataFrame:
        """The mix: for each slot the words it takes of each document (``from_word`` of the document, ``taken`` words)."""
        b = F.lit(self.block).cast("long")
        cut = self.documents.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {self.block}L, (start + size - 1) div {self.block}L)")))
        begin, end = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        cut = cut.select(F.col("sidx").alias("of"), F.col("block").alias("number"), "id", "source", "start", begin.alias("begin"), end.alias("end"))
        # a merge join always: the slots grow with the data, which their plan does not show
        both = self.slots.hint("merge").join(cut, (F.col("sidx") == F.col("of")) & (F.col("block") == F.col("number")))
        taken = F.least("end", F.col("block") * b + F.col("words")) - F.col("begin")
        return both.select("shard", "position", "epoch", "sidx", "source", "block", "id", "start", (F.col("begin") - F.col("start")).alias("from_word"), taken.alias("taken")).where("taken > 0")

    def totals(self) -> DataFrame:
        """Per document: its size, its source's size and target, and the words that the mix takes of it."""
        sums = self.pieces().groupBy(F.col("sidx").alias("of"), F.col("start").alias("at")).agg(F.sum("taken").alias("taken"))
        d = self.documents
        # documents without words share a place in the stream with the next one
        key = (F.col("sidx") == F.col("of")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
        return d.join(sums, key, "left").select(F.col("id").alias(self.id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all ``documents`` takes of each."""
    return Mix(table(spark, sf_dir, "documents")).totals()
