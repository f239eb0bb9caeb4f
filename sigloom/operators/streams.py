"""Streams and joins of samples and events that need not fit one array."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigloom.functions import kernels
from sigloom.functions.batches import changes, flat_lists
from sigloom.operators.chunks import _bases
from sigloom.operators.pulses import match_candidates
from sigloom.session import cut_lineage


class PeakStream:
    """Local maxima of a series that arrives piece by piece, with the lowest value before each.

    What is kept between pieces is the last run of equal values and the maxima so far.
    """

    def __init__(self) -> None:
        self.seen, self.low = 0, np.inf
        self.level: float | None = None  # of the run in hand, which began at ``start``
        self.start, self.before = 0, None
        self.pos: list[int] = []
        self.height: list[float] = []
        self.valley: list[float] = []

    def add(self, values: Sequence[float]) -> None:
        x = np.asarray(values, float)
        if not len(x):
            return
        first = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
        start, level = first + self.seen, x[first]
        self.seen += len(x)
        if self.level is not None and level[0] == self.level:
            start[0] = self.start
        elif self.level is not None:
            start, level = np.append(self.start, start), np.append(self.level, level)
        up = np.append(self.before is not None and level[0] > self.before, level[1:] > level[:-1])
        tops = np.flatnonzero(up[:-1] & (level[:-1] > level[1:]))
        at = 0
        for t in tops.tolist():
            self.pos.append(int(start[t] + start[t + 1] - 1) // 2)
            self.height.append(float(level[t]))
            self.valley.append(min(self.low, float(level[at : t + 1].min())))
            self.low, at = np.inf, t + 1
        if at < len(level) - 1:  # the run in hand counts when it ends
            self.low = min(self.low, float(level[at:-1].min()))
        if len(level) > 1:
            self.before = float(level[-2])
        self.start, self.level = int(start[-1]), float(level[-1])

    def peaks(self, distance: int, prominence: float) -> Iterator[tuple[int, float]]:
        """Those that stay after spacing, with at least that prominence."""
        if not self.pos:
            return
        pos, height, valley = np.array(self.pos), np.array(self.height), np.array(self.valley)
        after = np.append(valley[1:], min(self.low, self.level))
        alive = kernels.spaced_peaks(pos, height, distance)
        if prominence > 0:
            bases = np.maximum(_bases(height, valley), _bases(height[::-1], after[::-1])[::-1])
            alive &= height - bases >= prominence
        yield from zip(pos[alive].tolist(), height[alive].tolist())


def stream_peaks(
    rows: DataFrame, place: str, values: str, noise: DataFrame | None = None, distance: int = 1, noise_share: float = 0.0, key: str = "sample_id"
) -> DataFrame:
    """key, pos, score: the peaks of every signal (as ``pulses.find_peaks``) from rows of samples or of
    chunks in the order of ``place``. ``noise``: key, noise, of which a peak's prominence is at least
    ``noise_share`` times. A signal streams through a task, a batch of rows at a time, and is never held
    as an array."""
    named = rows.select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(values).alias("values"))
    if noise is None:
        named = named.withColumn("noise", F.lit(0.0))
    else:
        named = named.join(noise.select(F.col(key).alias("key"), "noise"), "key")
    chunked = isinstance(rows.schema[values].dataType, ArrayType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, held, least, found = None, None, 0.0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            column, share = batch.column("values"), batch.column("noise").to_numpy(zero_copy_only=False)
            x, begins = flat_lists(column) if chunked else (column.to_numpy(zero_copy_only=False), np.arange(len(column) + 1))
            cuts = np.append(np.flatnonzero(changes(batch, ["key"])), batch.num_rows).tolist()
            for a, b in zip(cuts, cuts[1:]):
                now = batch.column("key")[a].as_py()
                if stream is None or now != held:
                    if stream is not None:
                        found += [(held, *peak) for peak in stream.peaks(distance, least)]
                    stream, held = PeakStream(), now
                stream.add(x[begins[a] : begins[b]])
                least = noise_share * share[b - 1]
            if found:
                yield _peak_rows(found, batch.schema.field("key").type)
                found = []
        if stream is not None:
            found = [(held, *peak) for peak in stream.peaks(distance, least)]
            if found:
                yield _peak_rows(found, batch.schema.field("key").type)

    kind = rows.schema[key].dataType.simpleString()
    placed = named.repartition("key").sortWithinPartitions("key", "place")
    return placed.mapInArrow(run, f"key {kind}, pos int, score double").withColumnRenamed("key", key)


def _peak_rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, pos, score = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(pos, pa.int32()), pa.array(score, pa.float64())], names=["key", "pos", "score"])


def match_event_tables(
    left: DataFrame, right: DataFrame, tolerance: int, key: Sequence[str] = ("sample_id",), pos: str = "pos"
) -> tuple[DataFrame, int]:
    """(key, left_pos, right_pos of the greedy one-to-one match, number of rounds).

    Left events in order of position take their nearest free right event at most ``tolerance`` away,
    the earlier one of two equally near: the match of ``pulses.match_events``, for signals whose
    events do not fit one array. In a round, a left event takes its nearest free one unless an earlier
    undecided left event could still take it. The first undecided event of a signal can always decide.
    Positions are unique within a key.
    """
    key = list(key)
    open_pairs = cut_lineage(match_candidates(left, right, tolerance, key, pos))
    out, rounds = None, 0
    while not open_pairs.isEmpty():
        rounds += 1
        near = F.struct(F.abs(F.col("right_pos") - F.col("left_pos")).alias("off"), F.col("right_pos").alias("right_pos"))
        wanted = open_pairs.groupBy(*key, "left_pos").agg(F.min(near).alias("near")).select(*key, "left_pos", "near.right_pos")
        claims = open_pairs.groupBy(*key, "right_pos").agg(F.min("left_pos").alias("left_pos"))
        decided = cut_lineage(wanted.join(claims, [*key, "left_pos", "right_pos"]).select(*key, "left_pos", "right_pos"))
        out = decided if out is None else out.unionByName(decided)
        rest = open_pairs.join(decided.select(*key, "left_pos"), [*key, "left_pos"], "left_anti")
        open_pairs = cut_lineage(rest.join(decided.select(*key, "right_pos"), [*key, "right_pos"], "left_anti"))
    if out is None:
        out = open_pairs.select(*key, "left_pos", "right_pos")
    return out, rounds


def match_summary(left: DataFrame, right: DataFrame, pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Counts, share and offsets of a match, for every key with events on both sides; offsets of no pair
    are NaN."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("left_count")).join(
        right.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("right_count")), key
    )
    off = F.col("right_pos") - F.col("left_pos")
    found = pairs.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("_m"), F.percentile(off, F.lit(0.5)).alias("_o"), F.percentile(F.abs(off), F.lit(0.5)).alias("_a")
    )
    joined = counts.join(found, key, "left").withColumn("matched", F.coalesce("_m", F.lit(0)))
    union = F.greatest(F.col("left_count") + F.col("right_count") - F.col("matched"), F.lit(1))
    nan = F.lit(float("nan"))
    return joined.select(
        key, "left_count", "right_count", "matched", (F.col("matched") / union).alias("matched_fraction"),
        F.coalesce("_o", nan).alias("median_offset"), F.coalesce("_a", nan).alias("median_abs_offset"),
    )
