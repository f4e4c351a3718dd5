"""What the operators of this subpackage share: tables, shared storage, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bytetext as bt
from graphloom.scratch import materialize, shared_dir

__all__ = ["fresh", "grouped", "list_array", "logistic", "materialize", "shared_dir", "sliced", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def sliced(batches: Iterable[pa.RecordBatch], column: str | int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of bounded bytes of text, each with its bytes and offsets."""
    for batch in batches:
        data, offs = bt.column_bytes(batch.column(column))
        for i, j in bt.slices(offs):
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from batches whose rows of a group follow each other; with each, the groups' offsets.

    Only the last, unfinished group of a batch is carried over, so memory is
    bounded by a batch and the largest group.
    """
    rest: list[pa.RecordBatch] = []

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t[k].combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*rest, batch]).combine_chunks()
        at = cut(t)
        if len(at) > 2:
            yield t.slice(0, at[-2]), at[:-1]
        rest = t.slice(at[-2]).combine_chunks().to_batches()
    if rest:
        t = pa.Table.from_batches(rest).combine_chunks()
        yield t, cut(t)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
