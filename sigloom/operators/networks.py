"""Small perceptrons of many models, trained in the same passes.

Rows with equal features and target have equal logits by every model, so they are folded to one cell with
the numbers of rows that train and that stop each model. A pass sends the weights of all models to the
blocks of cells; every task gives one gradient array for
each model, the arrays are added by model, and the driver, which holds only weights, makes the step.
Steps follow the sign of each derivative and adapt their size (resilient propagation), so a full pass
needs no line search. Rows of a stop set give no gradient; when their loss has not fallen for
``patience`` passes, the model stops with the weights at which it was least.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.blocks import Blocks, Fit, model_moments, numbers, partitions, rows_of, sum_over_blocks, to_blocks, unpack
from sigloom.operators.boosting import fixed, held_out_score
from sigloom.session import cut_lineage

GROW, SHRINK, SMALLEST, LARGEST = 1.2, 0.5, 1e-6, 1.0


@dataclass(frozen=True)
class NetworkSpec:
    hidden: tuple[int, ...] = (16, 8)
    alpha: float = 1e-3
    steps: int = 150
    patience: int = 10
    tolerance: float = 1e-4
    first_step: float = 0.05
    seed: int = 42

    def shapes(self, inputs: int) -> list[tuple[int, int]]:
        sizes = [inputs, *self.hidden, 1]
        return list(zip(sizes, sizes[1:]))

    def start(self, inputs: int) -> np.ndarray:
        rng, parts = np.random.default_rng(self.seed), []
        for a, b in self.shapes(inputs):
            bound = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)


def layers(weights: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, weights: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Values of every layer; the last one is the logit."""
    values = [x]
    for i, (w, b) in enumerate(layers(weights, shapes)):
        z = values[-1] @ w + b
        values.append(z if i == len(shapes) - 1 else np.maximum(z, 0.0))
    return values


def losses(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, logit) - y * logit


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, shapes: Sequence[tuple[int, int]]) -> tuple[np.ndarray, float]:
    """Of the sum of losses; the penalty is not in it."""
    values = forward(x, weights, shapes)
    logit = values[-1][:, 0]
    return backward(values, 1 / (1 + np.exp(-logit)) - y, weights, shapes), float(losses(logit, y).sum())


def backward(values: list[np.ndarray], slope: np.ndarray, weights: np.ndarray, shapes: Sequence[tuple[int, int]]) -> np.ndarray:
    """The gradient from the values of every layer and the slope of each row's loss by its logit."""
    slope, parts, by_layer = slope[:, None], [], layers(weights, shapes)
    for i in reversed(range(len(shapes))):
        parts = [(values[i].T @ slope).ravel(), slope.sum(axis=0), *parts]
        if i:
            slope = (slope @ by_layer[i][0].T) * (values[i] > 0)
    return np.concatenate(parts)


def penalised(weights: np.ndarray, shapes: Sequence[tuple[int, int]]) -> np.ndarray:
    """The weights that the penalty is on: biases are 0."""
    out, at = weights.copy(), 0
    for a, b in shapes:
        out[at + a * b : at + a * b + b] = 0.0
        at += a * b + b
    return out


@dataclass
class Training:
    """Where one model stands."""

    weights: np.ndarray
    step: np.ndarray
    before: np.ndarray
    best: np.ndarray
    least: float = np.inf
    waited: int = 0
    passes: int = 0
    done: bool = False
    history: list[float] = field(default_factory=list)

    def move(self, slope: np.ndarray, loss: float, spec: NetworkSpec) -> None:
        """One step; ``loss``: that which decides when to stop."""
        self.history.append(loss)
        if loss < self.least - spec.tolerance:
            self.least, self.best, self.waited = loss, self.weights.copy(), 0
        else:
            self.waited += 1
        self.passes += 1
        self.done = self.waited >= spec.patience or self.passes >= spec.steps
        turn = np.sign(slope) * np.sign(self.before)
        self.step = np.clip(np.where(turn > 0, self.step * GROW, np.where(turn < 0, self.step * SHRINK, self.step)), SMALLEST, LARGEST)
        slope = np.where(turn < 0, 0.0, slope)
        self.weights = self.weights - np.sign(slope) * self.step
        self.before = slope


@dataclass
class Networks:
    spec: NetworkSpec
    features: tuple[str, ...]
    columns: tuple[tuple[int, ...], ...]
    centre: np.ndarray  # (models, features)
    spread: np.ndarray
    models: list[Training]
    #: probability of a model whose rows are of one class, else NaN
    constant: np.ndarray

    def logits(self, x: np.ndarray, m: int, weights: np.ndarray | None = None) -> np.ndarray:
        c = list(self.columns[m])
        z = (x[:, c] - self.centre[m, c]) / self.spread[m, c]
        return forward(z, self.models[m].best if weights is None else weights, self.spec.shapes(len(c)))[-1][:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.models)))
        for m, fixed in enumerate(self.constant):
            out[:, m] = fixed if np.isfinite(fixed) else 1 / (1 + np.exp(-self.logits(x, m)))
        return out


def fit_networks(
    df: DataFrame, key: str, target: str, fits: Sequence[Fit], spec: NetworkSpec = NetworkSpec(), name: str = "scores"
) -> tuple[DataFrame, Networks]:
    """(``df`` with the array ``name``: the probability of class 1 by every model of ``fits``, models).

    Features are standardised over the rows that train a model. The stop rows of a fit decide when it
    ends; without any, its own loss does. A model whose rows are all of one class gives that constant.
    """
    blocks = to_blocks(df, key, target, fits)
    d, models = len(blocks.shape.features), blocks.shape.models
    nets = Networks(spec, blocks.shape.features, blocks.shape.columns, np.zeros((models, d)), np.ones((models, d)), [], np.full(models, 0.0))
    size = np.zeros(models)
    for r in model_moments(blocks):
        m, n = r["model"], r["n"]
        size[m] = n
        nets.centre[m] = r["mean"]
        std = np.sqrt(np.array(r["m2"]) / n)
        nets.spread[m] = np.where(std > 0, std, 1.0)
        nets.constant[m] = 0.0 if r["p"] == 0 else 1.0 if r["p"] == n else np.nan
    for m in range(models):
        start = spec.start(len(blocks.shape.columns[m]))
        nets.models.append(Training(start, np.full(len(start), spec.first_step), np.zeros(len(start)), start, done=bool(np.isfinite(nets.constant[m]))))
    cells = _cells(blocks)
    while any(not t.done for t in nets.models):
        for m, (slope, loss, stop_loss, stop_n) in _pass(cells, nets).items():
            shapes, t = spec.shapes(len(blocks.shape.columns[m])), nets.models[m]
            decay = penalised(t.weights, shapes) * spec.alpha
            slope = (slope + decay) / size[m]
            own = (loss + 0.5 * float(decay @ t.weights)) / size[m]
            t.move(slope, stop_loss / stop_n if stop_n else own, spec)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [nets.probabilities(numbers(r, "x", np.float64, d)).tobytes() for r in rows_of([batch])]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(scores, pa.binary())], ["kept", "score"])

    scored = blocks.table.select("kept", "x").mapInArrow(score, "kept binary, score binary")
    return unpack(scored, blocks, name), nets


#: Cells of one block, and blocks of cells: features and target of each cell, and how many rows of it train
#: and stop each model, as the smallest integers that hold them.
CELL_ROWS = 8192
#: Cells that go through a network at a time: their values of all layers stay in a processor's cache.
SLICE = 2048
CELLS = "part int, block int, rows int, x binary, y binary, train binary, stop binary"


def counts(row: dict, name: str, models: int) -> np.ndarray:
    """(cells, models): the numbers of rows in a block of cells."""
    return np.frombuffer(row[name], f"u{len(row[name]) // (row['rows'] * models)}").reshape(-1, models)


def joined(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a column."""
    column = column.cast(pa.binary())
    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[begins[0] : begins[-1]]


def _cells(blocks: Blocks) -> Blocks:
    """The cells of all rows as blocks ``CELLS``."""
    d, models, parts = len(blocks.shape.features), blocks.shape.models, blocks.parts
    names = [c.split()[0] for c in CELLS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            flags = np.concatenate([numbers(r, c, np.uint8, models) for c in ("train", "stop")], axis=1)
            yield pa.RecordBatch.from_arrays([fixed(r["x"], 8 * d), pa.array(numbers(r, "y", np.float64)), fixed(flags.tobytes(), 2 * models)], ["x", "y", "flags"])

    single = blocks.table.select("x", "y", "train", "stop").mapInArrow(rows, "x binary, y double, flags binary").withColumn("hash", F.xxhash64("x"))
    # by the hash first: many rows share the first bytes of x, which a sort compares
    placed = single.repartition(parts, "hash").sortWithinPartitions("hash", "x", "y").withColumn("part", F.spark_partition_id())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in enumerate(batches):  # a cell on the border of two batches becomes two, with the same sums
            if not batch.num_rows:
                continue
            x, y = joined(batch.column("x")).view(np.float64).reshape(-1, d), batch.column("y").to_numpy()
            bits = x.view(np.uint64)
            first = np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]).any(axis=1) | (y[1:] != y[:-1])))
            n = np.add.reduceat(joined(batch.column("flags")).reshape(-1, 2 * models).astype(np.uint32), first, axis=0)
            values = [batch.column("part")[0].as_py(), block, len(first), x[first].tobytes(), y[first].tobytes(), n[:, :models].tobytes(), n[:, models:].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 3 else pa.binary()) for i, v in enumerate(values)], names)

    folded = cut_lineage(placed.select("part", "x", "y", "flags").mapInArrow(fold, CELLS))
    fewer = min(parts, partitions(folded.agg(F.sum("rows")).first()[0] or 0, CELL_ROWS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def make(block: int) -> pa.RecordBatch:
            of = lambda c: np.concatenate([counts(r, c, models) for r in held])
            smallest = [n.astype(np.min_scalar_type(n.max())).tobytes() for n in (of("train"), of("stop"))]
            values = [held[0]["part"] * fewer // parts, block, number, *(b"".join(r[c] for r in held) for c in ("x", "y")), *smallest]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 3 else pa.binary()) for i, v in enumerate(values)], names)

        block = 0
        for r in rows_of(batches):
            if held and number + r["rows"] > CELL_ROWS:
                yield make(block)
                held, number, block = [], 0, block + 1
            held.append(r)
            number += r["rows"]
        if held:
            yield make(block)

    dealt = folded.withColumn("slot", F.expr(f"cast(part * {fewer}L div {parts} AS int)")).repartitionById(fewer, "slot")
    table = cut_lineage(dealt.sortWithinPartitions("part", "block").drop("slot").mapInArrow(join, CELLS))
    return Blocks(table, blocks.shape, blocks.kept, fewer)


def _pass(cells: Blocks, nets: Networks) -> dict[int, tuple[np.ndarray, float, float, int]]:
    """Gradient, loss, loss of the stop rows and their number, for every model that is not done."""
    shape, spec = cells.shape, nets.spec
    d, models = len(shape.features), shape.models
    weights = {m: t.weights for m, t in enumerate(nets.models) if not t.done}

    def work(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        x, y = numbers(r, "x", np.float64, d), numbers(r, "y", np.float64)
        train, stop = (counts(r, c, models) for c in ("train", "stop"))
        for m, w in weights.items():
            rows = np.flatnonzero((train[:, m] > 0) | (stop[:, m] > 0))
            c, shapes = list(shape.columns[m]), spec.shapes(len(shape.columns[m]))
            for some in (rows[i : i + SLICE] for i in range(0, len(rows), SLICE)):
                values = forward((x[np.ix_(some, c)] - nets.centre[m, c]) / nets.spread[m, c], w, shapes)
                logit, target, n, held = values[-1][:, 0], y[some], train[some, m].astype(float), stop[some, m].astype(float)
                loss = losses(logit, target)
                slope = backward(values, (1 / (1 + np.exp(-logit)) - target) * n, w, shapes)
                yield m, np.append(slope, [loss @ n, loss @ held, held.sum()])

    found = sum_over_blocks(cells, ["rows", "x", "y", "train", "stop"], work, len(weights))
    return {m: (s[:-3], float(s[-3]), float(s[-2]), int(s[-1])) for m, s in found.items()}


def cross_fit_networks(
    df: DataFrame, features: Sequence[str], fold: str = "fold", target: str = "target", key: str = "sample_id",
    spec: NetworkSpec = NetworkSpec(), stop_in: str | None = None,
) -> DataFrame:
    """Out-of-fold probabilities. ``stop_in``: an array column with the folds for which a row belongs to
    the stop set (``splits.stop_sets``); such rows train the models of the other folds only."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-fitting needs at least two folds")
    fits = []
    for f in folds:
        outside = F.col(fold) != F.lit(f)
        stops = F.lit(False) if stop_in is None else F.coalesce(F.array_contains(stop_in, F.lit(f)), F.lit(False))
        fits.append(Fit(tuple(features), outside & ~stops, outside & stops))
    scored, _ = fit_networks(df, key, target, fits, spec)
    return scored.withColumn("probability", held_out_score(fold, folds)).drop("scores")
