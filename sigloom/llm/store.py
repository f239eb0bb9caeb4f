"""Intermediate tables and array files in the shared folder."""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from sigloom.session import shared_folder


def shared_path(spark, label: str) -> str:
    """A new path in the folder that all executors share; it goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/sigloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as compressed Parquet and read it again: later steps do not depend on the
    executors or on the plan that made it, and columns and filters reach the files."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _local(uri: str) -> str | None:
    """The path of a folder that is mounted on every machine; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def write_shared(uri: str, data: bytes) -> None:
    """Write a file of the shared folder from a task. It appears whole, so a task that is run
    again, even beside the first one, replaces it by the same bytes."""
    part = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as file:
            file.write(data)
        os.replace(_local(part), path)
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{part.rsplit('.', 1)[1]}"
    with fs.open_output_stream(part) as file:
        file.write(data)
    fs.move(part, path)


def map_shared(uri: str) -> np.ndarray | None:
    """Bytes of a file of the shared folder, mapped and not read; None if there is none. A file
    that cannot be mapped where it is, is mapped from a copy without a name."""
    if path := _local(uri):
        # as a plain array: slices and look-ups of a memmap cost several times as much
        return np.asarray(np.memmap(path, np.uint8, "r")) if os.path.exists(path) else None
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
        shutil.copyfileobj(source, copy, 1 << 20)
        copy.flush()
        return np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
