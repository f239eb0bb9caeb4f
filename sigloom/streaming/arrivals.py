"""Signals arriving as files: running moments, and a stored transform with exact coverage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.checks import ContractError
from sigloom.session import shared_folder


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def arriving(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file stream with the schema of the files already there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_moments(stream: DataFrame, values: str, length: int, out: str | None = None) -> DataFrame:
    """Running n, mean and population std per array position over everything that arrived.

    The state is one row per position. A signal of another length fails the query; a stream
    without rows is an error. Each trigger replaces the small result table.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, "moments")
    sound = F.when(F.size(values) == length, F.col(values)).otherwise(
        F.raise_error(F.lit("signal length changed in the stream")).cast("array<double>")
    )
    running = stream.select(F.posexplode(sound).alias("pos", "v")).groupBy("pos").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    query = (
        running.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    result = spark.read.schema("pos int, n bigint, mean double, std double").parquet(f"{out}/table")
    if result.isEmpty():
        raise ContractError("the stream held no signals")
    return result.withColumn("std", F.when(F.col("std") < 1e-6, F.lit(1.0)).otherwise(F.col("std")))


def store_stream(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], expected_rows: int, key: Sequence[str], out: str | None = None,
    rows_per_key: int = 1,
) -> DataFrame:
    """Write the transformed stream to Parquet exactly once and check its coverage.

    The checkpoint makes restarts resume after the last finished batch. At the end,
    ``expected_rows`` distinct keys must be there, each with ``rows_per_key`` rows.
    """
    spark = stream.sparkSession
    out = out or work_path(spark, "stored")
    query = (
        transform(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stored = spark.read.parquet(f"{out}/table")
    per_key = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    got = per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") != rows_per_key).alias("odd")).first()
    if got["keys"] != expected_rows or got["odd"]:
        raise ContractError(f"stored {got['keys']} of {expected_rows} expected samples, {got['odd']} of them with missing or repeated rows")
    return stored
