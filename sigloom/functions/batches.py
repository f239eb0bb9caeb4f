"""Arrow UDFs over signals, and over small groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal_udf(returns: str) -> Callable:
    """A pandas UDF that runs once per row.

    The optimizer copies a deterministic expression wherever it is used, for instance into
    the non-empty filter it infers below an explode, and would run the kernel again for
    each copy. Declaring the UDF non-deterministic keeps it at one evaluation.
    """

    def wrap(fn: Callable):
        return F.pandas_udf(fn, returns).asNondeterministic()

    return wrap


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists, and where each row's begin in them (one more than rows)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def lists(values: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    """The other way round."""
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values))


def rows_of(begins: np.ndarray) -> np.ndarray:
    """The row of every number of a column of lists."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether a row has another key than the one before; true for the first."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for k in keys:
        out[1:] |= np.diff(pd.factorize(batch.column(k).to_pandas())[0]) != 0
    return out


def key_of(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def whole_groups(
    df: DataFrame, keys: Sequence[str], schema: str, work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]
) -> DataFrame:
    """``work(batch, begins)`` of many groups at once: batches of whole groups, and where each begins in its
    batch (one more than groups). A task keeps a batch and the group in hand."""
    keys = list(keys)

    def ready(parts: list) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return work(whole, np.append(np.flatnonzero(changes(whole, keys)), whole.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes(batch, keys)
            new[0] = not held or key_of(held[-1], keys, -1) != key_of(batch, keys, 0)
            cut = np.flatnonzero(new)
            if held and len(cut):
                yield ready([*held, batch.slice(0, cut[-1])])
                held = []
            elif len(cut) and cut[-1]:
                yield ready([batch.slice(0, cut[-1])])
            held.append(batch.slice(cut[-1]) if len(cut) else batch)
        if held:
            yield ready(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def stream_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, work: Callable[[list], Iterable[tuple]], parts: int | None = None
) -> DataFrame:
    """``work(rows)`` of every group, rows in ``order`` as named tuples, on partitions sorted by key.

    One frame holds many small groups, so a group costs its rows and no conversion of its own. The
    group in hand is all that a task keeps. ``parts``: of how many partitions, where there are few groups.
    """
    names = [c.strip().split()[0] for c in schema.split(", ")]
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, out = [], None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now and held:
                    out += work(held)
                    held = []
                now = key
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            yield pd.DataFrame(list(work(held)), columns=names)

    placed = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return placed.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
