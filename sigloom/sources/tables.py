"""Score-table sinks, stored representations, fingerprints and file inventories."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.scalars import is_finite
from sigloom.operators.checks import ContractError, require, require_columns, unique_rows

WIDE_KEYS = ("sample_id", "label", "dataset_id", "split", "seed", "config_version")


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ("dataset_id", "seed")) -> None:
    """Write a wide prediction table; a repeated sample or missing column fails the job.

    The uniqueness check is part of the write job, and rows are clustered by the partition
    columns; adaptive execution sizes the files and splits a large partition over tasks.
    """
    require_columns(df, WIDE_KEYS)
    checked = unique_rows(df, [*partition_by, "split", "sample_id"], "sample_id repeats in the prediction table")
    checked.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_table(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def prediction_frame(
    base: DataFrame, scores: dict[str, DataFrame], dataset_id: str, config_version: str, key: Sequence[str] = ("sample_id",)
) -> DataFrame:
    """One ``probability_<method>`` column per method, joined on the sample key.

    Each method table must hold every sample once with a probability in [0,1].
    """
    out = base.withColumns({"dataset_id": F.lit(dataset_id), "config_version": F.lit(config_version)})
    for method, table in scores.items():
        col = f"probability_{method}"
        side = unique_rows(table.select(*key, F.col("probability").alias(col)), key, f"{method} repeats a sample")
        joined = out.join(side, list(key), "left")
        ok = F.coalesce(is_finite(col) & F.col(col).between(0.0, 1.0), F.lit(False))
        out = require(joined, ok, f"{method} lacks a sample or leaves [0,1]")
    return out


# Fingerprints ---------------------------------------------------------------------------


def canonical_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def parameter_fingerprint(params: dict) -> str:
    return hashlib.sha256(canonical_json(params).encode()).hexdigest()


WORDS = 4


def row_digest(cols: Sequence[str]) -> Column:
    """sha256 (hex) of the row. Each value is written as its length and its text, a null as a
    mark of its own, so no two different rows are written alike."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order-independent content fingerprint in one row: row count, and xor and sum of the four
    60-bit words at the front of each quarter of the digest.

    A plain aggregation, so it scales with the scan; the sums keep pairs of equal rows from
    cancelling as they would in the xors alone.
    """
    d = df.select(row_digest(cols).alias("d"))
    words = d.select(*[F.conv(F.substring("d", 16 * k + 1, 15), 16, 10).cast("bigint").alias(f"w{k}") for k in range(WORDS)])
    return words.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.bit_xor(f"w{k}").alias(f"xor_{k}") for k in range(WORDS)],
        *[F.sum(F.col(f"w{k}") % F.lit(1_000_000_007)).alias(f"sum_{k}") for k in range(WORDS)],
    )


# Stored representations -----------------------------------------------------------------


def save_representation(df: DataFrame, root: str, params: dict, partition_by: Sequence[str] = ()) -> str:
    """Write a table once under its parameters' fingerprint; a finished one is kept.

    The manifest row is written after the data, so a crash between the two leaves an
    incomplete representation that readers refuse.
    """
    spark = df.sparkSession
    path = f"{root}/{parameter_fingerprint(params)}"
    if representation_state(spark, root, params) == "complete":
        return path
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").count()
    manifest = [(parameter_fingerprint(params), canonical_json(params), rows)]
    spark.createDataFrame(manifest, "fingerprint string, params string, rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def representation_state(spark: SparkSession, root: str, params: dict) -> str:
    path = f"{root}/{parameter_fingerprint(params)}"
    if not _exists(spark, f"{path}/data/_SUCCESS") or not _exists(spark, f"{path}/manifest/_SUCCESS"):
        return "absent"
    return "complete"


def load_representation(spark: SparkSession, root: str, params: dict) -> DataFrame:
    """The stored table for exactly these parameters, with its row count checked against the manifest."""
    path = f"{root}/{parameter_fingerprint(params)}"
    if representation_state(spark, root, params) != "complete":
        raise ContractError("no complete representation for these parameters")
    manifest = spark.read.schema("fingerprint string, params string, rows bigint").json(f"{path}/manifest").first()
    if manifest is None or manifest["params"] != canonical_json(params):
        raise ContractError("stored parameters differ from the requested ones")
    data = spark.read.parquet(f"{path}/data")
    if data.count() != manifest["rows"]:
        raise ContractError("stored row count differs from the manifest")
    return data


def _sha256_of(path: str, block: int = 1 << 20) -> str:
    """sha256 of a file of any size, read in blocks."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with store.open_input_stream(place) as stream:
        while part := stream.read(block):
            digest.update(part)
    return digest.hexdigest()


def file_inventory(spark: SparkSession, glob: str, expected: Iterable[str] = ()) -> DataFrame:
    """Name, size and sha256 of each file, and expected files that are absent.

    Spark lists the files without reading them; tasks then hash them in blocks, so a file may
    have any size and takes one block of memory.
    """

    def hashed(batches):
        for batch in batches:
            yield batch.assign(sha256=[_sha256_of(p) for p in batch["path"]])

    listed = spark.read.format("binaryFile").load(glob).select("path", "length").repartition("path")
    files = listed.mapInPandas(hashed, "path string, length bigint, sha256 string").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "sha256"
    )
    wanted = spark.createDataFrame([(e,) for e in expected], "name string").withColumn("required", F.lit(True))
    return files.join(wanted, "name", "full_outer").select(
        "name", "bytes", "sha256", F.col("sha256").isNotNull().alias("present"), F.coalesce("required", F.lit(False)).alias("required")
    )
