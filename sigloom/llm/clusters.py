"""Centroid clustering of integer vectors by bit planes and population counts.

Every component of a vector of 64 integers gives one bit to each plane, so a plane is one 64-bit
word. In two's complement plane b weighs 2**b and the last one -2**b. The inner product of a vector
and a centroid is the weighted sum of popcount(plane of one AND plane of the other), which is exact,
and so is the squared distance |x|^2 - 2 x.c + |c|^2.

Vectors are packed once and stored. A round is one narrow pass over the planes; tasks add up their
vectors by cluster before anything is shuffled, and the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import stored

DIM = 64
#: Integers must lie in [-LIMIT, LIMIT): 64 squared differences then fit 63 bits.
LIMIT = 1 << 27
_U = np.uint64
_ROWS = 4096


def whole_vectors(vectors: DataFrame, scale: int = 256, dim: int = DIM) -> DataFrame:
    """vec_id and vec = floor(scale * x) per component, as long.

    Vectors that are null, have another number of components or hold a null or non-finite component
    take no part; nor do rows without a vec_id. Integers outside [-2**27, 2**27) raise, since their
    squared distances may not fit a long.
    """
    xs = F.col("embedding").cast("array<double>")
    bad = F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floor = F.transform(xs, lambda x: F.floor(x * F.lit(float(scale))))
    far = F.exists(xs, lambda x: (x * F.lit(float(scale)) < -LIMIT) | (x * F.lit(float(scale)) >= LIMIT))
    error = F.raise_error(F.lit(f"a component times {scale} is outside [-{LIMIT}, {LIMIT})"))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(far, error).otherwise(floor.cast("array<long>")).alias("vec"))


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, 64) integers to (rows, planes) words: bit i of word b is bit b of component i."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def unpack(words: np.ndarray) -> np.ndarray:
    rows, planes = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(rows, planes, 8), axis=2, bitorder="little")
    return np.einsum("rpi,p->ri", bits, weights(planes), dtype=np.int64)


def weights(planes: int) -> np.ndarray:
    """Of the planes of two's complement numbers."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def planes_of(low: int, high: int) -> int:
    """Planes that hold all integers from ``low`` to ``high``."""
    return 1 + max(int(high).bit_length(), int(~low).bit_length() if low < 0 else 0)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of packed vectors: (rows, other rows)."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(weights(left.shape[1])):
        part = np.zeros_like(out)
        for j, b in enumerate(weights(right.shape[1])):
            part += b * np.bitwise_count(left[:, i, None] & right[None, :, j])
        out += a * part
    return out


def nearest(words: np.ndarray, centers: np.ndarray, center_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and the squared distance."""
    own = unpack(words)
    distance = (own * own).sum(axis=1)[:, None] - 2 * products(words, center_words) + (centers * centers).sum(axis=1)[None, :]
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _words(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    flat = batch.column("planes")
    return flat.flatten().to_numpy().view(np.uint64).reshape(len(flat), planes)


def packed(vectors: DataFrame, planes: int) -> DataFrame:
    """vec_id and the bit planes of vec. A stored table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                values = batch.column("vec").flatten().to_numpy().reshape(-1, DIM)
                words = pack(values, planes).view(np.int64)
                offsets = pa.array(np.arange(0, words.size + 1, planes), pa.int32())
                rows = pa.ListArray.from_arrays(offsets, pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows], ["vec_id", "planes"])

    return stored(vectors.select("vec_id", "vec").mapInArrow(work, "vec_id long, planes array<long>"), "planes")


def _sums(rows: DataFrame, planes: int, centers: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every non-empty cluster; one small row per task and cluster."""
    center_words = pack(centers, planes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centers), np.int64), np.zeros((len(centers), DIM), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                words = _words(whole.slice(at, _ROWS), planes)
                best, _ = nearest(words, centers, center_words)
                count += np.bincount(best, minlength=len(centers))
                np.add.at(total, best, unpack(words))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"]
        )

    parts = rows.mapInArrow(work, "cluster long, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(DIM)])
    return {r[0]: (r[1], list(r[2:])) for r in sums.collect()}  # at most one row per centroid


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector
    (``whole_vectors``) after ``rounds`` rounds and a last assignment.

    The centroids start as the k vectors whose sha256 of ``seed:vec_id`` is smallest; among rows that
    share a vec_id, the smaller vector comes first. With fewer than k vectors all of them start. A
    vector belongs to the nearest centroid, ties to the smaller number; a non-empty centroid becomes
    the floor of its vectors' mean, an empty one stays. Rows that repeat take part each. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    low, high = vectors.select(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    if low is None:
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    planes = planes_of(low, high)
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = vectors.orderBy(code, "vec").limit(k).collect()
    centers = np.array([r["vec"] for r in start], np.int64)
    rows = packed(vectors, planes)
    for _ in range(rounds):
        for number, (n, total) in _sums(rows, planes, centers).items():
            centers[number] = [t // n for t in total]
    return assign(rows, planes, centers)


def assign(rows: DataFrame, planes: int, centers: np.ndarray) -> DataFrame:
    """The last assignment, with the sums of distances by cluster and over all."""
    spark = rows.sparkSession
    center_words = pack(centers, planes)
    codes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                best, distance = nearest(_words(batch, planes), centers, center_words)
                arrays = [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    found = rows.mapInArrow(work, "vec_id long, cluster int, distance long")
    wide = F.sum(F.col("distance").cast("decimal(19,0)"))
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(wide).collect()}  # at most one row per centroid
    table = [(c, s, sum(sums.values()), codes[c]) for c, s in sums.items()]
    names = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
