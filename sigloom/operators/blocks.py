"""Rows as blocks of numbers, for models that are fitted together in the same passes.

A block is one row of a stored table: the features of up to ``BLOCK_ROWS`` rows as one array, their
targets, which models each row trains and which models it stops, and the original columns as they
are. Every row is stored once, however many models it serves. Rows are placed by the hash of their
key and sorted inside a block, so blocks, sums and models do not depend on how the input lay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sigloom.functions.batches import stream_groups
from sigloom.functions.scalars import is_finite
from sigloom.operators.checks import require
from sigloom.session import cut_lineage

BLOCK_ROWS = 8192
#: A task has one block up to so many blocks, then up to ``TASK_BLOCKS``: a pass over many rows is long
#: enough for a task, and its own time must not grow with a task for every block.
LONE_BLOCKS, TASK_BLOCKS = 64, 8
SCHEMA = "part int, block int, rows int, kept binary, x binary, y binary, train binary, stop binary"


@dataclass(frozen=True)
class Fit:
    """One of many models: its features and the rows that it is fitted on. ``stop``: rows that only
    say when to stop."""

    features: tuple[str, ...]
    train: Column
    stop: Column | None = None


@dataclass(frozen=True)
class Shape:
    """What tasks need to know of the blocks."""

    features: tuple[str, ...]
    models: int
    #: of each model: the places of its features
    columns: tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Blocks:
    table: DataFrame
    shape: Shape
    kept: StructType
    #: partitions of the table
    parts: int = 1


def to_blocks(df: DataFrame, key: str, target: str, fits: Sequence[Fit], block_rows: int = BLOCK_ROWS) -> Blocks:
    """Store ``df`` as blocks. Features that are null or not finite raise."""
    features = tuple(dict.fromkeys(f for fit in fits for f in fit.features))
    no = F.lit(False)
    flags = lambda cs: F.array(*[F.coalesce(c, no).cast("tinyint") for c in cs])
    wide = df.select(
        F.struct(*df.columns).alias("kept"),
        F.col(key).alias("_key"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("y"),
        flags([fit.train for fit in fits]).alias("train"),
        flags([no if fit.stop is None else fit.stop for fit in fits]).alias("stop"),
    )
    wide = cut_lineage(wide)
    parts = partitions(wide.count(), block_rows)
    # Checked on stored numbers: pushed below the columns, the check would compute each feature many times.
    sound = F.forall("x", lambda v: F.coalesce(is_finite(v), no))
    placed = require(wide, sound, "a feature is null or not finite").repartition(parts, "_key").withColumn("part", F.spark_partition_id()).sortWithinPartitions("_key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, block = [], 0, 0

        def make(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            flat = lambda name, kind: table.column(name).combine_chunks().flatten().to_numpy().astype(kind).tobytes()
            kept = pa.RecordBatch.from_struct_array(table.column("kept").combine_chunks())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_batch(kept)
            values = [
                int(table.column("part")[0].as_py()), block, table.num_rows, sink.getvalue().to_pybytes(), flat("x", np.float64),
                table.column("y").to_numpy().astype(np.float64).tobytes(), flat("train", np.uint8), flat("stop", np.uint8),
            ]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int32()] * 3 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            number += batch.num_rows
            while number >= block_rows:
                whole = pa.concat_tables(held)
                yield make(whole.slice(0, block_rows))
                held, number, block = [whole.slice(block_rows)], number - block_rows, block + 1
        if number:
            yield make(pa.concat_tables(held))

    table = cut_lineage(placed.select("part", "kept", "x", "y", "train", "stop").mapInArrow(pack, SCHEMA))
    columns = tuple(tuple(features.index(f) for f in fit.features) for fit in fits)
    return Blocks(table, Shape(features, len(fits), columns), df.schema, parts)


def partitions(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Partitions of the table of blocks, by its rows alone: sums do not depend on the cluster."""
    blocks = max(1, -(-rows // block_rows))
    return max(min(blocks, LONE_BLOCKS), -(-blocks // TASK_BLOCKS))


def numbers(row: dict, name: str, kind: type, width: int | None = None) -> np.ndarray:
    """An array of a block; ``width``: numbers of each row."""
    flat = np.frombuffer(row[name], kind)
    return flat if width is None else flat.reshape(-1, width)


def reducers(models: int) -> int:
    """Partitions in which the sums of so many models are added up."""
    return max(1, -(-models // 32))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # one block at a time as Python bytes
            yield batch.slice(i, 1).to_pylist()[0]


def model_moments(blocks: Blocks) -> list:
    """model, n, positives, mean and m2 of each feature over the rows that train it. Blocks are merged
    with their means, so close values far from zero keep their digits."""
    models, d = blocks.shape.models, len(blocks.shape.features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for r in rows_of(batches):
            x, y = numbers(r, "x", np.float64, d), numbers(r, "y", np.float64)
            train = numbers(r, "train", np.uint8, models).astype(bool)
            for m in range(models):
                part = x[train[:, m]]
                if len(part):
                    mean = part.mean(axis=0)
                    rows.append((m, r["part"], r["block"], len(part), int((y[train[:, m]] == 1).sum()), mean.tolist(), ((part - mean) ** 2).sum(axis=0).tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                ["model", "part", "block", "n", "p", "mean", "m2"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "block"])
        n, means = pdf["n"].to_numpy()[:, None], np.stack(pdf["mean"].to_numpy())
        grand = (n * means).sum(axis=0) / n.sum()
        m2 = np.stack(pdf["m2"].to_numpy()).sum(axis=0) + (n * (means - grand) ** 2).sum(axis=0)
        return pd.DataFrame([(int(pdf["model"].iloc[0]), int(n.sum()), int(pdf["p"].sum()), grand, m2)], columns=["model", "n", "p", "mean", "m2"])

    arrays = "mean array<double>, m2 array<double>"
    parts = blocks.table.select("part", "block", "x", "y", "train").mapInArrow(work, f"model int, part int, block int, n long, p long, {arrays}")
    return parts.groupBy("model").applyInPandas(merge, f"model int, n long, p long, {arrays}").collect()  # one row per model


def sum_over_blocks(blocks: Blocks, columns: Sequence[str], work: Callable[[dict], Iterable[tuple[int, np.ndarray]]], keys: int) -> dict[int, np.ndarray]:
    """Arrays of numbers that ``work`` gives for integer keys (models), added up over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        part = 0
        for r in rows_of(batches):
            part = r["part"]
            for k, sums in work(r):
                total[k] = total[k] + sums if k in total else sums
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([np.asarray(s, float).tobytes() for s in total.values()], pa.binary())],
                ["key", "part", "sums"],
            )

    return gather(blocks.table.select("part", *columns).mapInArrow(run, "key int, part int, sums binary"), blocks.parts, keys)


#: Arrays that the driver adds up itself: so many partitions times keys. More are added by key in the
#: cluster first, and one array for each key comes to the driver.
DIRECT = 512


def gather(partial: DataFrame, parts: int, keys: int) -> dict[int, np.ndarray]:
    """Sums of the arrays in ``partial`` (key, part, sums) by key, in the order of the parts."""

    def add(rows: list) -> Iterator[tuple]:
        yield rows[0].key, sum(np.frombuffer(r.sums) for r in rows).tobytes()

    if parts * keys > DIRECT:
        partial = stream_groups(partial, ["key"], ["part"], "key int, sums binary", add, reducers(keys)).withColumn("part", F.lit(0))
    out: dict[int, np.ndarray] = {}
    for r in sorted(partial.collect(), key=lambda r: (r["key"], r["part"])):
        out[r["key"]] = out[r["key"]] + np.frombuffer(r["sums"]) if r["key"] in out else np.frombuffer(r["sums"])
    return out


def unpack(df: DataFrame, blocks: Blocks, name: str = "scores") -> DataFrame:
    """The original rows with ``name``: the numbers of every model in the binary column ``score``."""
    models = blocks.shape.models

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            kept = pa.ipc.open_stream(row["kept"]).read_all().combine_chunks().to_batches()[0]
            score = pa.array(np.frombuffer(row["score"], np.float64))
            offsets = pa.array(np.arange(0, (kept.num_rows + 1) * models, models)[: kept.num_rows + 1], pa.int32())
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(offsets, score)], [*kept.schema.names, name])

    return df.select("kept", "score").mapInArrow(work, StructType([*blocks.kept.fields, StructField(name, ArrayType(DoubleType()))]))
