"""Operators over signals that are cut into chunks, for signals that do not fit one row.

A chunked signal is one row per (signal, chunk): chunk 0, 1, ... with ``size`` consecutive samples
each, the last one with what is left (``read_wide_signals(chunk=size)`` or ``cut_signals``). Nothing
ever puts a signal together again:

* A linear recursion maps the state at the start of a chunk to that at its end by a small affine
  map. Each chunk gives one row with its map, the maps are composed along the signal in blocks of
  bounded size, and a second pass filters every chunk from its right start state.
* A moving average is a difference of running sums; the sums of other chunks travel as slices.
* Medians are exact: sorted summaries of the chunks bound the middle ranks, and only values between
  the bounds are gathered, each with its number.
* Landmarks, maxima and their neighbours are event tables with ordinary windows over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import kernels
from sigloom.functions.batches import changes, flat_lists, key_of, lists, rows_of, stream_groups, whole_groups
from sigloom.operators.pulses import PulsePolicy
from sigloom.session import cut_lineage

#: Chunk maps that one task composes, and values by which a chunk bounds its ranks.
FAN, MARKS = 1024, 64
#: Samples of a chunk that one product of matrices takes.
PIECE = 4096
VALUES = "array<double>"


def cut_signals(df: DataFrame, size: int, values: str = "values", keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Whole signals to chunks of ``size`` samples; an empty or null signal has none."""
    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(size))
    parts = F.transform(starts, lambda s: F.slice(values, s + 1, F.lit(size)).cast(VALUES))
    return df.where(F.size(values) > 0).select(*keep, F.posexplode(parts).alias("chunk", "values")).withColumn(
        "chunk", F.col("chunk").cast("long")
    )


def samples(chunks: DataFrame, size: int, key: str = "sample_id", values: str = "values") -> DataFrame:
    """key, pos, value of every sample."""
    rows = chunks.select(key, "chunk", F.posexplode(values).alias("_i", "value"))
    return rows.select(key, (F.col("chunk") * size + F.col("_i")).alias("pos"), "value")


def _equal_lengths(begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length, and the places of their numbers as a matrix, for every length of a batch."""
    n = np.diff(begins)
    for length in np.unique(n):
        at = np.flatnonzero(n == length)
        yield at, begins[at][:, None] + np.arange(length)


def _field(df: DataFrame, column: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}"


# Linear recursions --------------------------------------------------------------------


@dataclass(frozen=True)
class Recursion:
    """A linear filter as parallel first-order branches: y = direct * x + the sum of the branches,
    of which each is b[t] = residue * x[t] + pole * b[t - 1]. With ``steady``, the branches start as
    if the first sample had been there for ever; else at zero."""

    direct: float
    poles: tuple[complex, ...]
    residues: tuple[complex, ...]
    steady: bool = False

    def _real(self, state: np.ndarray) -> bool:
        return not any(np.imag(self.poles)) and not any(np.imag(self.residues)) and not np.imag(state).any()

    def branches(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Sum of the branches for each row of x, which they enter in that row's state."""
        real = self._real(state)
        number, start = (lambda v: float(np.real(v)), np.real(state)) if real else (complex, state)
        out = np.zeros(x.shape)
        for p, r, s in zip(self.poles, self.residues, start.T):
            out += kernels.first_order_rows(x, number(p), number(r), s).real
        return out

    def ends(self, x: np.ndarray) -> np.ndarray:
        """State at the end of each row of x that begins at zero."""
        p, r = np.array(self.poles, complex), np.array(self.residues, complex)
        state = np.zeros((len(x), len(p)), complex)
        for a in range(0, x.shape[1], PIECE):
            part = x[:, a : a + PIECE]
            n = part.shape[1]
            state = p**n * state + part @ (r * p ** np.arange(n - 1, -1, -1)[:, None])
        return state

    def starts(self, first: np.ndarray) -> np.ndarray:
        p, r = np.array(self.poles, complex), np.array(self.residues, complex)
        return r * first[:, None] / (1 - p) if self.steady else np.zeros((len(first), len(p)), complex)


def _states(column: pa.Array, branches: int) -> np.ndarray:
    return np.ascontiguousarray(flat_lists(column)[0]).view(complex).reshape(-1, branches)


def _state_lists(state: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(state, complex).view(float)
    return lists(flat.ravel(), np.arange(len(flat) + 1) * flat.shape[1])


def entering_states(maps: DataFrame, recursion: Recursion, key: str, fan: int = FAN) -> DataFrame:
    """key, step, state: the state in which the recursion enters each step of a signal.

    ``maps`` has key, step (0, 1, ...), n, first (its first sample) and end (the state at its end if
    it starts at zero). At most ``fan`` maps of a signal meet in a task; more are composed block by
    block, and the blocks again.
    """
    poles = np.array(recursion.poles, complex)
    kinds = f"{_field(maps, key)}, step long, state {VALUES}"
    most = maps.agg(F.max("step")).first()[0] or 0

    def walk(groups: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, carry = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                end, n = _states(batch.column("end"), len(poles)), batch.column("n").to_numpy()
                grow, state = poles ** n[:, None], np.empty_like(end)
                begins = np.flatnonzero(changes(batch, groups))
                length = np.diff(begins, append=len(n))
                if "state" in batch.schema.names:
                    now = _states(batch.column("state"), len(poles))[begins]
                else:
                    now = recursion.starts(batch.column("first").to_numpy()[begins])
                if held == key_of(batch, groups, 0):  # goes on from the batch before
                    now[0] = carry
                longest = np.argsort(-length, kind="stable")
                for j in range(length.max()):  # a step of all signals that have one more
                    live = longest[: np.searchsorted(-length[longest], -j)]
                    at = begins[live] + j
                    state[at] = now[live]
                    now[live] = grow[at] * now[live] + end[at]
                held, carry = key_of(batch, groups, -1), now[-1]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("step"), _state_lists(state)], names=[key, "step", "state"])

        return run

    def in_order(df: DataFrame, groups: list[str]) -> DataFrame:
        return df.repartition(*groups).sortWithinPartitions(*groups, "step").mapInArrow(walk(groups), kinds)

    if most < fan:
        return in_order(maps.select(key, "step", "n", "first", "end"), [key])

    def fold(rows: list) -> Iterator[tuple]:
        state = np.zeros(len(poles), complex)
        for r in rows:
            state = poles ** int(r.n) * state + np.asarray(r.end).view(complex)
        yield getattr(rows[0], key), rows[0].block, sum(r.n for r in rows), rows[0].first, state.view(float).tolist()

    blocks = maps.withColumn("block", F.expr(f"step div {fan}"))
    folded = stream_groups(blocks, [key, "block"], ["step"], f"{_field(maps, key)}, step long, n long, first double, end {VALUES}", fold)
    above = entering_states(cut_lineage(folded), recursion, key, fan).withColumnRenamed("step", "block")
    return in_order(blocks.join(above, [key, "block"]), [key, "block"])


def apply_recursion(chunks: DataFrame, recursion: Recursion, key: str = "sample_id", last: str | None = None) -> DataFrame:
    """The chunks with filtered ``values``. With ``last`` (a column: the signal's last chunk) the
    recursion runs from the end of each signal to its beginning."""
    step = F.col("chunk") if last is None else F.col(last) - F.col("chunk")
    back = last is not None

    @F.arrow_udf(f"n long, first double, end {VALUES}")
    def ends(values: pa.Array) -> pa.Array:
        x, begins = flat_lists(values)
        state = np.zeros((len(begins) - 1, len(recursion.poles)), complex)
        for at, place in _equal_lengths(begins):
            state[at] = recursion.ends(x[place[:, ::-1] if back else place])
        first = x[begins[1:] - 1] if back else x[begins[:-1]]
        return pa.StructArray.from_arrays([pa.array(np.diff(begins)), pa.array(first), _state_lists(state)], names=["n", "first", "end"])

    @F.arrow_udf(VALUES)
    def run(values: pa.Array, states: pa.Array) -> pa.Array:
        x, begins = flat_lists(values)
        state, out = _states(states, len(recursion.poles)), recursion.direct * x
        for at, place in _equal_lengths(begins):
            place = place[:, ::-1] if back else place
            out[place] += recursion.branches(x[place], state[at])
        return lists(out, begins)

    maps = chunks.select(key, step.cast("long").alias("step"), ends.asNondeterministic()("values").alias("m")).select(key, "step", "m.*")
    states = entering_states(cut_lineage(maps), recursion, key)
    joined = chunks.withColumn("step", step.cast("long")).join(states, [key, "step"])
    return joined.withColumn("values", run.asNondeterministic()("values", "state")).drop("step", "state")


def flatten(chunks: DataFrame, alpha: float, beta: float, key: str = "sample_id") -> DataFrame:
    """Every signal minus its first-order low-pass with pole (alpha - beta) / alpha."""
    return apply_recursion(chunks, Recursion(1.0, ((alpha - beta) / alpha,), (-beta / alpha,)), key)


def signal_facts(chunks: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, last_chunk, length of every signal."""
    return chunks.groupBy(key).agg(F.max("chunk").alias("last_chunk"), F.sum(F.size("values")).alias("length"))


def butterworth_highpass(chunks: DataFrame, size: int, order: int, cutoff: float, rate: float, key: str = "sample_id") -> DataFrame:
    """Zero-phase Butterworth high-pass: forward and backward over an odd extension of the ends."""
    direct, poles, residues = kernels._highpass_branches(order, cutoff, rate)
    recursion = Recursion(direct, poles, residues, steady=True)
    pad = F.least(F.lit(3 * (order + 1)), F.col("length") - 1)
    reach = -(-(3 * (order + 1) + 1) // size)
    facts = signal_facts(chunks, key)
    marked = chunks.join(facts, key)
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["values"]))
    near = marked.where((F.col("chunk") <= reach) | (F.col("chunk") >= F.col("last_chunk") - reach))
    piece = F.struct("chunk", "values")
    ends = near.groupBy(key, "last_chunk", "length").agg(  # a few chunks of each end
        ordered(F.when(F.col("chunk") <= reach, piece)).alias("_head"),
        ordered(F.when(F.col("chunk") >= F.col("last_chunk") - reach, piece)).alias("_tail"),
    )
    head, tail = F.slice("_head", F.lit(1), pad + 1), F.reverse(F.slice(F.reverse("_tail"), F.lit(1), pad + 1))
    odd = lambda a, edge: F.transform(F.reverse(a), lambda v: edge * 2 - v)
    sides = ends.select(
        key,
        "last_chunk",
        odd(F.slice(head, F.lit(2), pad), F.get(head, F.lit(0))).alias("_before"),
        odd(F.slice(tail, F.lit(1), pad), F.element_at(tail, -1)).alias("_after"),
    )
    nothing = F.array().cast(VALUES)
    sides = sides.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("chunk"), F.col("_before").alias("before"), nothing.alias("after")),
                F.struct(F.col("last_chunk").alias("chunk"), nothing.alias("before"), F.col("_after").alias("after")),
            )
        ).alias("s"),
    ).select(key, "s.*")
    sides = sides.groupBy(key, "chunk").agg(F.flatten(F.collect_list("before")).alias("_before"), F.flatten(F.collect_list("after")).alias("_after"))
    longer = marked.join(sides, [key, "chunk"], "left").withColumns(
        {"_before": F.coalesce("_before", nothing), "_after": F.coalesce("_after", nothing)}
    )
    longer = longer.withColumn("values", F.concat("_before", "values", "_after")).withColumns(
        {"_skip": F.size("_before"), "_rest": F.size("_after")}
    )
    longer = cut_lineage(longer.drop("_before", "_after"))
    forward = cut_lineage(apply_recursion(longer, recursion, key))
    back = apply_recursion(forward, recursion, key, last="last_chunk")
    kept = F.slice("values", F.col("_skip") + 1, F.size("values") - F.col("_skip") - F.col("_rest"))
    return back.withColumn("values", kept).drop("_skip", "_rest", "last_chunk", "length")


# Medians ------------------------------------------------------------------------------


def exact_medians(chunks: DataFrame, key: str = "sample_id", values: str = "values") -> DataFrame:
    """key, median of every signal, as of its whole sorted values.

    A chunk tells at most ``MARKS`` + 1 of its sorted values with their ranks. They bound the middle
    ranks of the signal; then only the values between the bounds are gathered, about one in
    ``MARKS`` / 2 and each distinct value once.
    """

    @F.arrow_udf("mark array<double>, rank array<long>")
    def marks(column: pa.Array) -> pa.Array:
        x, begins = flat_lists(column)
        x = x[np.lexsort((x, rows_of(begins)))]  # each chunk sorted
        n = np.diff(begins)
        ranks = {k: np.unique(np.linspace(0, k - 1, min(k, MARKS + 1)).astype(int)) for k in np.unique(n).tolist()}
        told = np.concatenate([[0], np.cumsum([len(ranks[k]) for k in n.tolist()])]).astype(np.int64)
        rank = np.concatenate([np.empty(0, np.int64), *[ranks[k] for k in n.tolist()]])
        return pa.StructArray.from_arrays([lists(x[begins[:-1][rows_of(told)] + rank], told), lists(rank, told)], names=["mark", "rank"])

    def bounds(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        n = np.add.reduceat(batch.column("n").to_numpy(), begins[:-1])
        mark, told = flat_lists(batch.column("mark"))
        rank, row = flat_lists(batch.column("rank"))[0], rows_of(told)
        opens = np.diff(row, prepend=-1) > 0
        sure = np.where(opens, rank + 1, np.diff(rank, prepend=0))  # these are at most the mark
        maybe = np.where(np.append(opens[1:], True), 1, np.diff(rank, append=0))  # these may follow it
        order, group, runs, final = _sorted_runs(mark, rows_of(begins)[row])
        mark, heads = mark[order], np.searchsorted(group, np.arange(len(n)))
        sure, maybe = np.cumsum(sure[order]), np.concatenate([[0], np.cumsum(maybe[order])])
        sure, maybe = sure - np.append(0, sure)[heads][group], maybe[:-1] - maybe[heads][group]
        below = maybe[runs]  # an upper bound of the values under each mark
        low = np.maximum.reduceat(np.where(below <= ((n - 1) // 2)[group], mark, -np.inf), heads)
        high = np.minimum.reduceat(np.where(sure[final] >= (n // 2 + 1)[group], mark, np.inf), heads)
        keys = batch.column(key).take(pa.array(begins[:-1]))
        return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(low), pa.array(high)], names=[key, "n", "low", "high"])

    said = chunks.select(key, F.size(values).cast("long").alias("n"), marks.asNondeterministic()(values).alias("m")).select(key, "n", "m.*")
    found = cut_lineage(whole_groups(said, [key], f"{_field(chunks, key)}, n long, low double, high double", bounds))

    @F.arrow_udf("below long, value array<double>, often array<long>")
    def inside(column: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        x, begins = flat_lists(column)
        row, rows = rows_of(begins), np.arange(len(begins))
        a, b = low.to_numpy()[row], high.to_numpy()[row]
        below = np.bincount(row[x < a], minlength=len(begins) - 1)
        near = (x >= a) & (x <= b)
        order, row, runs, _ = _sorted_runs(x[near], row[near])
        first, often = np.unique(runs, return_counts=True)
        told = np.searchsorted(row[first], rows)
        return pa.StructArray.from_arrays(
            [pa.array(below), lists(x[near][order][first], told), lists(often, told)], names=["below", "value", "often"]
        )

    def middle(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        n, below = batch.column("n").to_numpy()[begins[:-1]], np.add.reduceat(batch.column("below").to_numpy(), begins[:-1])
        value, told = flat_lists(batch.column("value"))
        order, group, _, _ = _sorted_runs(value, rows_of(begins)[rows_of(told)])
        value, up_to = value[order], np.concatenate([[0], np.cumsum(flat_lists(batch.column("often"))[0][order])])
        heads = np.searchsorted(group, np.arange(len(n) + 1))
        pick = []
        for k in ((n - 1) // 2, n // 2):
            at = np.searchsorted(up_to[1:], up_to[heads[:-1]] + k - below, side="right")
            if ((at < heads[:-1]) | (at >= heads[1:])).any():
                raise ValueError("a median is not a number")
            pick.append(value[at])
        keys = batch.column(key).take(pa.array(begins[:-1]))
        return pa.RecordBatch.from_arrays([keys, pa.array((pick[0] + pick[1]) / 2)], names=[key, "median"])

    near = chunks.select(key, F.col(values).alias("_v")).join(found, key)
    near = near.select(key, "n", inside.asNondeterministic()("_v", "low", "high").alias("i")).select(key, "n", "i.*")
    return whole_groups(near, [key], f"{_field(chunks, key)}, median double", middle)


def _sorted_runs(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by group and value, the groups in it, and the first and last place of each one's equals."""
    order = np.lexsort((value, group))
    value, group = value[order], group[order]
    same = (value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1]))
    first = np.flatnonzero(np.append(True, ~same | (group[1:] != group[:-1])))[: len(value)]
    often = np.diff(first, append=len(value))
    return order, group, np.repeat(first, often), np.repeat(first + often - 1, often)


# Moving average and cycle reference ----------------------------------------------------


def moving_average(chunks: DataFrame, size: int, width: int, key: str = "sample_id") -> DataFrame:
    """Centred mean over offsets -(width // 2) ... width - width // 2 - 1, edges replicated."""
    left, right = width // 2, width - width // 2
    adding = Recursion(0.0, (1.0,), (1.0,))
    sums = cut_lineage(apply_recursion(chunks.withColumn("_raw", F.col("values")), adding, key))
    facts = sums.groupBy(key).agg(
        F.sum(F.size("values")).alias("length"),
        F.min_by(F.get("_raw", F.lit(0)), "chunk").alias("first"),
        F.max_by(F.element_at("_raw", -1), "chunk").alias("final"),
        F.max_by(F.element_at("values", -1), "chunk").alias("total"),
    )
    piece = f"{_field(chunks, key)}, chunk long, upper boolean, at long, part {VALUES}"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums up to sample t are wanted at t - right as the upper and at t + left as the lower one."""
        for batch in batches:
            running, begins = flat_lists(batch.column("values"))
            chunk, row = batch.column("chunk").to_numpy(), rows_of(begins)
            t = chunk[row] * size + 1 + np.arange(len(row)) - begins[row]
            heads = np.flatnonzero(chunk == 0)  # the sum of nothing
            running, row, t = (np.insert(c, begins[heads], v) for c, v in ((running, 0.0), (row, heads), (t, 0)))
            for upper, shift in ((True, -right), (False, left)):
                keep = t + shift >= 0
                yield _pieces(batch, key, row[keep], (t + shift)[keep], running[keep], size, pa.scalar(upper))

    def average(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        start, n = of("chunk")[begins[:-1]] * size, of("length")[begins[:-1]]
        out = np.concatenate([[0], np.cumsum(np.minimum(size, n - start))])
        group, whole = rows_of(out), begins[:-1][rows_of(out)]
        here = start[group] + np.arange(len(group)) - out[group]
        ends = {True: of("total")[whole] + (here + right - n[group]) * of("final")[whole], False: (here - left) * of("first")[whole]}
        part, told = flat_lists(batch.column("part"))
        row = rows_of(told)
        place, target = of("at")[row] + np.arange(len(row)) - told[row], rows_of(begins)[row]
        inner = place < np.diff(out)[target]  # sums behind the last sample are wanted by none
        for upper, end in ends.items():
            take = inner & (of("upper")[row] == upper)
            end[out[target[take]] + place[take]] = part[take]
        keys = [batch.column(c).take(pa.array(begins[:-1])) for c in (key, "chunk")]
        return pa.RecordBatch.from_arrays([*keys, lists((ends[True] - ends[False]) / width, out)], names=[key, "chunk", "values"])

    sent = sums.select(key, "chunk", "values").mapInArrow(send, piece).join(facts, key)
    sent = sent.where(F.col("chunk") * size < F.col("length"))
    return whole_groups(sent, [key, "chunk"], f"{_field(chunks, key)}, chunk long, values {VALUES}", average)


def _pieces(batch: pa.RecordBatch, key: str, row: np.ndarray, at: np.ndarray, x: np.ndarray, size: int, upper: pa.Scalar | None = None) -> pa.RecordBatch:
    """Samples of the batch's rows with their new places, as key, chunk, (upper,) at, part: a piece is
    consecutive samples of one row for one chunk."""
    target = at // size
    cut = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(target) != 0) | (np.diff(at) != 1)))[: len(row)]
    columns = {key: batch.column(key).take(pa.array(row[cut])), "chunk": pa.array(target[cut])}
    if upper is not None:
        columns["upper"] = pa.repeat(upper, len(cut))
    columns |= {"at": pa.array((at - target * size if upper is not None else at)[cut]), "part": lists(x, np.append(cut, len(row)))}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def zero_crossings(chunks: DataFrame, size: int, key: str = "sample_id") -> DataFrame:
    """key, pos, rising: where the signal crosses zero between pos - 1 and pos."""
    edges = chunks.select(key, (F.col("chunk") + 1).alias("chunk"), F.element_at("values", -1).alias("_last"))
    joined = chunks.select(key, "chunk", "values").join(edges, [key, "chunk"], "left")

    @F.arrow_udf("pos array<long>, rising array<boolean>")
    def cross(values: pa.Array, last: pa.Array) -> pa.Array:
        x, begins = flat_lists(values)
        row = rows_of(begins)
        before = np.append(np.nan, x[:-1])[: len(x)]
        before[begins[:-1]] = last.to_numpy(zero_copy_only=False)  # not a number, thus no crossing, for the first chunk
        up, down = (before <= 0) & (x > 0), (before >= 0) & (x < 0)
        at = np.flatnonzero(up | down)
        told = np.searchsorted(row[at], np.arange(len(begins)))
        return pa.StructArray.from_arrays([lists(at - begins[row[at]], told), lists(up[at], told)], names=["pos", "rising"])

    found = joined.select(key, "chunk", cross.asNondeterministic()("values", "_last").alias("c"))
    rows = found.select(key, "chunk", F.explode(F.arrays_zip("c.pos", "c.rising")).alias("e"))
    return rows.select(key, (F.col("chunk") * size + F.col("e.pos")).alias("pos"), F.col("e.rising").alias("rising"))


def cycle_reference(chunks: DataFrame, size: int, policy: PulsePolicy, key: str = "sample_id") -> DataFrame:
    """key, success, origin, opposite, half_period, inferred, reason of every signal: the landmarks
    of its smoothed and centred curve, as the reference of a whole signal gives them."""
    n, half = policy.length, policy.half
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = chunks.groupBy(key).agg(F.sum(F.size("values")).alias("_n"), F.bool_and(finite).alias("_ok"))
    sound = sound.select(key, ((F.col("_n") == n) & F.col("_ok")).alias("_sound"))
    usable = chunks.join(sound.where("_sound"), key, "left_semi")
    smooth = cut_lineage(moving_average(usable, size, policy.smoothing, key))
    centred = smooth.join(exact_medians(smooth, key), key).withColumn(
        "values", F.transform("values", lambda x: x - F.col("median"))
    )
    crossings = cut_lineage(zero_crossings(centred, size, key))
    firsts = crossings.groupBy(key).agg(
        F.min(F.when(F.col("rising"), F.col("pos"))).alias("rise"),
        F.min(F.when(~F.col("rising"), F.col("pos"))).alias("fall"),
        F.max(F.when(~F.col("rising"), F.col("pos"))).alias("late"),
    )
    # each rising crossing asks for the falling ones on both sides of half a period later
    want = F.when(F.col("rising"), (F.col("pos") + half) % n).otherwise(F.col("pos"))
    around = Window.partitionBy(key).orderBy("at")
    fall = F.when(~F.col("rising"), F.col("pos"))
    sides = crossings.withColumn("at", want).withColumns(
        {
            "low": F.last(fall, ignorenulls=True).over(around.rangeBetween(Window.unboundedPreceding, -1)),
            "high": F.first(fall, ignorenulls=True).over(around.rangeBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = sides.where("rising").join(firsts.select(key, "fall", "late"), key)
    rows = rows.select(key, F.col("pos").alias("origin"), F.explode(F.array(F.coalesce("low", "late"), F.coalesce("high", "fall"))).alias("opposite"))
    gap = F.pmod(F.col("opposite") - F.col("origin"), F.lit(n))
    gap = F.when(gap == 0, F.lit(n)).otherwise(gap)
    best = rows.where("opposite IS NOT NULL").groupBy(key).agg(
        F.min(F.struct(F.abs(gap - half).alias("off"), "origin", "opposite")).alias("pair")
    )
    joined = chunks.select(key).distinct().join(sound, key).join(firsts, key, "left").join(best, key, "left")
    paired = F.col("pair.off") <= half // 4
    none = F.col("rise").isNull() & F.col("fall").isNull()
    only_fall = F.col("rise").isNull()
    origin = F.when(paired, F.col("pair.origin")).when(only_fall, (F.col("fall") + half) % n).otherwise(F.col("rise"))
    opposite = F.when(paired, F.col("pair.opposite")).when(only_fall, F.col("fall")).otherwise((F.col("rise") + half) % n)
    success = F.col("_sound") & ~none
    reason = F.when(~F.col("_sound"), "wrong length or non-finite values").when(none, "no crossing")
    return joined.select(
        key,
        success.alias("success"),
        F.when(success, origin).cast("int").alias("origin"),
        F.when(success, opposite).cast("int").alias("opposite"),
        F.when(success, F.lit(half)).alias("half_period"),
        F.when(success, ~F.coalesce(paired, F.lit(False))).alias("inferred"),
        reason.alias("reason"),
    )


def roll(chunks: DataFrame, size: int, origins: DataFrame, length: int, key: str = "sample_id") -> DataFrame:
    """Circular shift of every signal that moves its ``origin`` to the front; ``origins``: key, origin.
    A chunk is sent in at most three pieces; signals without an origin are left out."""
    moved = chunks.join(origins.where("origin IS NOT NULL").select(key, F.col("origin").cast("long").alias("_o")), key)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, begins = flat_lists(batch.column("values"))
            row = rows_of(begins)
            at = (batch.column("chunk").to_numpy() * size - batch.column("_o").to_numpy() - begins[:-1])[row] + np.arange(len(row))
            at[at < 0] += length
            yield _pieces(batch, key, row, at, x, size)

    sent = moved.select(key, "chunk", "_o", "values").mapInArrow(send, f"{_field(chunks, key)}, chunk long, at long, part {VALUES}")
    pieces = F.array_sort(F.collect_list(F.struct("at", "part")))  # of one chunk
    return sent.groupBy(key, "chunk").agg(F.flatten(F.transform(pieces, lambda p: p["part"])).alias("values"))


# Peaks ---------------------------------------------------------------------------------


def local_maxima(chunks: DataFrame, size: int, key: str = "sample_id") -> DataFrame:
    """key, pos, height, valley: the samples above both neighbours, a flat top once at its middle,
    with the lowest sample since the previous maximum (for the first one, since the beginning).

    A chunk tells its inner maxima at once. Runs of equal samples at its ends are put together with
    those of the neighbours in windows over these end runs.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, begins = flat_lists(batch.column("values"))
            if not len(x):
                continue
            row = rows_of(begins)
            opens = np.diff(row, prepend=-1) > 0
            first = np.flatnonzero(opens | np.append(True, x[1:] != x[:-1]))  # of each run of equal samples of a chunk
            end = np.append(first[1:], len(x)) - 1
            level, opens = x[first], opens[first]
            closes = np.append(opens[1:], True)
            up = np.append(False, level[1:] > level[:-1])
            down = np.append(level[:-1] > level[1:], False)
            # maxima; the runs at both ends of a chunk are kept in any case
            at = np.flatnonzero((up & down) | opens | closes)
            lows = np.minimum.reduceat(level, np.append(0, at[:-1] + 1))
            opens, closes, here = opens[at], closes[at], row[first[at]]
            base = batch.column("chunk").to_numpy()[here] * size - begins[here]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(here)), pa.array(first[at] + base), pa.array(end[at] + base), pa.array(level[at]),
                    pa.array(lows), pa.array(opens | closes), pa.array(level[at - 1], mask=opens), pa.array(level[(at + 1) % len(level)], mask=closes),
                ],
                names=[key, "start", "stop", "height", "low", "edge", "before", "after"],
            )

    schema = f"{_field(chunks, key)}, start long, stop long, height double, low double, edge boolean, before double, after double"
    found = chunks.select(key, "chunk", "values").mapInArrow(runs, schema)
    order = Window.partitionBy(key).orderBy("start")
    # Neighbouring end runs of one level are one run.
    same = F.col("edge") & F.lag("edge").over(order) & F.col("before").isNull() & (F.lag("height").over(order) == F.col("height"))
    grouped = found.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn("_run", F.sum("_new").over(order))
    whole = grouped.groupBy(key, "_run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("height").alias("height"), F.min("low").alias("low"),
        F.min_by("before", "start").alias("before"), F.max_by("after", "start").alias("after"),
    )
    before = F.coalesce("before", F.lag("height").over(order))
    after = F.coalesce("after", F.lead("height").over(order))
    marked = whole.withColumn("_top", (before < F.col("height")) & (after < F.col("height")))
    marked = marked.withColumn("_top", F.coalesce("_top", F.lit(False)))
    # the valley before a maximum: the lowest since the maximum before it
    part = F.sum(F.col("_top").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_part", F.coalesce(part, F.lit(0).cast("long")))
    low = F.least("low", "height")
    valley = F.min(low).over(Window.partitionBy(key, "_part").orderBy("start"))
    rest = F.min(low).over(order.rowsBetween(1, Window.unboundedFollowing))
    tops = marked.withColumns({"valley": valley, "_after": rest}).where("_top")
    return tops.select(key, F.expr("(start + stop) div 2").alias("pos"), "height", "valley", F.col("_after").alias("after"))


PEAK_FIELDS = "pos long, height double, prominence double"


def spaced_prominent(maxima: DataFrame, distance: int, key: str = "sample_id") -> DataFrame:
    """key, pos, height, prominence of the maxima (``local_maxima``) that stay when, from the highest
    down, each drops lower ones nearer than ``distance``. A group is the maxima of one signal."""

    def pick(rows: list) -> Iterator[tuple]:
        at, height, valley = (np.array([getattr(r, c) for r in rows]) for c in ("pos", "height", "valley"))
        alive = kernels.spaced_peaks(at, height, distance)
        final = rows[-1].after
        following = np.append(valley[1:], height[-1] if final is None or np.isnan(final) else min(final, height[-1]))
        left, right = _bases(height, valley), _bases(height[::-1], following[::-1])[::-1]
        for i in np.flatnonzero(alive):
            yield getattr(rows[0], key), at[i], height[i], height[i] - max(left[i], right[i])

    return stream_groups(maxima, [key], ["pos"], f"{_field(maxima, key)}, {PEAK_FIELDS}", pick)


def _bases(height: np.ndarray, valley: np.ndarray) -> np.ndarray:
    """For every maximum, the lowest sample back to the nearest strictly higher maximum."""
    base, stack = np.empty(len(height)), []
    for i, (h, low) in enumerate(zip(height.tolist(), valley.tolist())):
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        base[i] = low
        stack.append((h, low))
    return base


def highpass_events(
    chunks: DataFrame, size: int, rate: float, order: int = 5, cutoff: float = 20_000.0, distance: int = 40,
    prominence_mad: float = 6.0, keep: int = 1024, key: str = "sample_id",
) -> DataFrame:
    """The high-pass detector: key, noise, candidates, pos, score, sign of the ``keep`` highest peaks
    of |filtered - median| whose prominence is at least ``prominence_mad`` times the noise."""
    shaped = cut_lineage(butterworth_highpass(chunks, size, order, cutoff, rate, key))
    middle = exact_medians(shaped, key)
    centred = cut_lineage(shaped.join(middle, key).withColumn("values", F.transform("values", lambda x: x - F.col("median"))).drop("median"))
    spread = centred.join(exact_medians(centred, key), key).withColumn("values", F.transform("values", lambda x: F.abs(x - F.col("median"))))
    robust = exact_medians(cut_lineage(spread.drop("median")), key)

    @F.arrow_udf("n double, mean double, m2 double")
    def moments(values: pa.Array) -> pa.Array:
        x, begins = flat_lists(values)
        n = np.diff(begins).astype(float)
        mean = np.add.reduceat(x, begins[:-1]) / n
        apart = x - mean[rows_of(begins)]
        return pa.StructArray.from_arrays([pa.array(c) for c in (n, mean, np.add.reduceat(apart * apart, begins[:-1]))], names=["n", "mean", "m2"])

    parts = cut_lineage(centred.select(key, moments.asNondeterministic()("values").alias("m")).select(key, "m.*"))
    totals = parts.groupBy(key).agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))
    std = parts.join(totals, key).groupBy(key).agg(F.sqrt(F.sum(apart) / F.max("n_all")).alias("std"))
    noise = robust.join(std, key).select(key, F.greatest(F.col("median") * 1.4826, F.col("std") * 0.05, F.lit(1e-6)).alias("noise"))
    height = centred.withColumn("values", F.transform("values", F.abs))
    peaks = spaced_prominent(local_maxima(height, size, key), distance, key).join(noise, key)
    peaks = peaks.where(F.col("prominence") >= F.col("noise") * prominence_mad)
    peaks = peaks.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(key)))
    ranked = peaks.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("height"), "pos"))).where(F.col("rank") <= keep)
    value = F.get("values", F.col("_i").cast("int"))
    located = ranked.withColumns({"chunk": F.expr(f"pos div {size}"), "_i": F.col("pos") % size}).join(centred, [key, "chunk"])
    return located.select(key, "noise", "candidates", "rank", "pos", F.col("height").alias("score"), F.signum(value).cast("int").alias("sign"))
