"""Signal sources: wide column-per-signal Parquet, array Parquet, metadata CSV."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.arrays import array_mean, central_moments
from sigloom.operators.checks import ContractError, require

METADATA = "signal_id string, id_measurement string, phase string"


def read_wide_signals(
    spark: SparkSession, path: str, ids: Sequence[str], chunk: int | None = None, batch: int = 200
) -> DataFrame:
    """Column-per-signal Parquet -> (sample_id, file, chunk, n, values), in row order.

    Only the requested columns are read, ``batch`` of them in one scan. The sample index is the
    row's position in its file; a table of several files is continued in file-name order. Tasks
    turn their rows into arrays column by column, so what travels is pieces of signals, not
    samples. With ``chunk``, each file is cut into arrays of that many consecutive samples, so a
    signal is assembled by many tasks; without it a signal is one array. Values stay float if
    all requested columns are, and are double otherwise.
    """
    wide = spark.read.parquet(path)
    missing = sorted(set(ids) - set(wide.columns))
    if missing:
        raise ContractError(f"signals not in the file: {missing}")
    kinds = dict(wide.dtypes)
    kind = "float" if all(kinds[c] == "float" for c in ids) else "double"
    index, name = F.col("_metadata.row_index"), F.col("_metadata.file_name")
    schema = f"sample_id string, file string, chunk bigint, start bigint, piece array<{kind}>"
    out = None
    for start in range(0, len(ids), batch):
        cols = list(ids[start : start + batch])
        rows = wide.select(index.alias("_i"), name.alias("_f"), *[F.col(f"`{c}`").cast(kind).alias(c) for c in cols])
        pieces = rows.mapInArrow(_pieces(cols, chunk), schema)
        out = pieces if out is None else out.unionByName(pieces)
    ordered = F.array_sort(F.collect_list(F.struct("file", "start", "piece")))  # of one chunk, or one signal
    keys = ["sample_id", "file", "chunk"] if chunk else ["sample_id", "chunk"]
    joined = out.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.flatten(F.transform(ordered, lambda s: s["piece"])).alias("values"), F.min("file").alias("file")
    )
    return joined.select(
        F.col("_k_sample_id").alias("sample_id"), "file", F.col("_k_chunk").alias("chunk"), F.size("values").alias("n"), "values"
    )


def _pieces(cols: Sequence[str], chunk: int | None):
    """Arrow batches of rows -> for each column, arrays of consecutive rows of one file and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, file = batch.column("_i").to_numpy(), batch.column("_f")
            part = index // chunk if chunk else np.zeros(len(index), np.int64)
            codes = file.dictionary_encode().indices.to_numpy()
            breaks = (np.diff(index) != 1) | (np.diff(part) != 0) | (np.diff(codes) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(breaks) + 1, [len(index)]]).astype(np.int32)
            if len(index) == 0:
                continue
            starts = pa.array(cuts[:-1])
            for c in cols:
                values = batch.column(c)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c] * len(starts)), file.take(starts), pa.array(part[cuts[:-1]]), pa.array(index[cuts[:-1]]),
                        pa.ListArray.from_arrays(pa.array(cuts), values),
                    ],
                    ["sample_id", "file", "chunk", "start", "piece"],
                )

    return run


def read_metadata(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Metadata CSV with string ids; the schema is declared, never inferred."""
    declared = METADATA + (", target int" if labelled else "")
    header = spark.read.option("header", True).csv(path).columns
    wanted = [f.strip().split(" ")[0] for f in declared.split(",")]
    missing = sorted(set(wanted) - set(header))
    if missing:
        raise ContractError(f"metadata lacks columns {missing}")
    types = dict(f.strip().split(" ") for f in declared.split(","))
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).select(*wanted)


def read_array_signals(
    spark: SparkSession, path: str, length: int, id_col: str, values: str, partition: str, label: str | None = "label"
) -> DataFrame:
    """Fixed-length array signals; a wrong length or a non-finite sample fails the query."""
    raw = spark.read.parquet(path)
    a = F.col(values)
    sound = (F.size(a) == length) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    checked = require(raw, F.coalesce(sound, F.lit(False)), f"signals must hold {length} finite samples")
    labels = [F.col(label).cast("int").alias("label")] if label else [F.lit(None).cast("int").alias("label")]
    return checked.select(
        F.format_string(f"{partition}:%08d", F.col(id_col)).alias("sample_id"),
        F.lit(partition).alias("partition"),
        *labels,
        F.size(a).alias("n"),
        a.cast("array<double>").alias("values"),
    )


def profile_signals(df: DataFrame, n: int, rate_hz: float, key: str = "sample_id", values: str = "values") -> DataFrame:
    """Value audit of the first ``n`` signals by key."""
    a = F.col(values)
    head = df.orderBy(key).limit(n).withColumn("_m", central_moments(values))
    return head.select(
        key,
        F.size(a).alias("n"),
        F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))).alias("finite"),
        F.array_min(a).alias("minimum"),
        F.array_max(a).alias("maximum"),
        array_mean(values).alias("mean"),
        F.sqrt(F.col("_m.m2") / F.col("_m.n")).alias("std"),
        (F.size(a) / F.lit(rate_hz)).alias("seconds"),
    )
