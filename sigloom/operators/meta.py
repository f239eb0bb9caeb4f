"""Cross-fitted meta fusion: every operating point is learned off the rows it is applied to.

Model f of a (dataset, seed) is fitted on the out-of-fold rows outside fold f and applied to fold f;
model -1 is fitted on all of them and applied to validation rows. Rows are stored once, as blocks. A
model is a few numbers on the driver: calibration, cut-offs, weight, reliability coefficients, delta.
Each pass over the blocks serves all models: Newton sums for calibration and reliability, and counts
by cell of the threshold grid for every threshold, weight and delta that is tried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.blocks import Blocks, Fit, Shape, numbers, rows_of, sum_over_blocks, to_blocks, unpack
from sigloom.operators.linear import newton_sums
from sigloom.operators.models import FINAL, FUSED, _newton
from sigloom.operators.sweeps import DELTAS, FIRST, LAST, STEPS

EXPERTS = ("temporal", "spectral")
INPUTS, POINTS, CELLS = 11, 21, LAST - FIRST + 2
_NUMBERS = ("x", "y", "train")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def logit(p: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    p = np.clip(p, eps, 1.0 - eps)
    return np.log(p / (1.0 - p))


def inputs_of(p: np.ndarray) -> np.ndarray:
    """The signal-level inputs of a reliability model, (rows, 11); ``p``: both probabilities."""
    p = np.clip(p, 1e-6, 1.0 - 1e-6)
    c = np.clip(p, 1e-7, 1.0 - 1e-7)
    entropy = -(c * np.log2(c) + (1 - c) * np.log2(1 - c))
    apart = p[:, 0] - p[:, 1]
    same = (p[:, 0] >= 0.5) == (p[:, 1] >= 0.5)
    return np.column_stack([p, logit(p), np.abs(p - 0.5), entropy, np.abs(apart), apart, same.astype(float)])


def cells(p: np.ndarray) -> np.ndarray:
    """Place of each probability among the cells of the threshold grid, 0 below all thresholds."""
    k = np.floor(p * STEPS)
    k = np.where(p < k / STEPS, k - 1, np.where(p >= (k + 1) / STEPS, k + 1, k))
    return np.clip(k, FIRST - 1, LAST).astype(np.int64) - (FIRST - 1)


def counted(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by cell and class."""
    return np.bincount(cells(p) * 2 + (y == 1), minlength=2 * CELLS).astype(float)


def best_threshold(counts: np.ndarray) -> tuple[float, float]:
    """(threshold, MCC): among the thresholds within 1e-8 + 1e-5 * |best|, the one nearest 0.5."""
    table = counts.reshape(CELLS, 2)
    above = np.cumsum(table[::-1], axis=0)[::-1][1:]
    n, p = table.sum(axis=0)
    fp, tp = above[:, 0], above[:, 1]
    tn, fn = n - fp, p - tp
    scale = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = np.divide(tp * tn - fp * fn, scale, out=np.zeros(len(tp)), where=scale != 0)
    k = np.arange(FIRST, LAST + 1)
    near = np.abs(mcc - mcc.max()) <= 1e-8 + 1e-5 * abs(mcc.max())
    pick = min(np.flatnonzero(near), key=lambda i: (abs(int(k[i]) - STEPS // 2), k[i]))
    return float(k[pick]) / STEPS, float(mcc[pick])


@dataclass
class MetaModel:
    """The numbers of one model."""

    platt: np.ndarray  # (experts, 2): intercept and slope on the logit
    cuts: dict[str, float]
    mcc: dict[str, float]
    weight: float
    centre: np.ndarray
    spread: np.ndarray
    reliability: np.ndarray  # (experts, 12)
    delta: float = 0.0

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.platt[None, :, 0] + self.platt[None, :, 1] * logit(raw))

    def design(self, p: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(p)), (inputs_of(p) - self.centre) / self.spread])

    def right(self, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each expert's decision is the target."""
        cuts = np.array([self.cuts[e] for e in EXPERTS])
        return ((p >= cuts[None, :]) == (y[:, None] == 1)).astype(float)

    def mixed(self, p: np.ndarray) -> np.ndarray:
        return self.weight * p[:, 0] + (1.0 - self.weight) * p[:, 1]

    def trusted(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The reliability-weighted mean, and how far the reliabilities lie apart."""
        r = sigmoid(self.design(p) @ self.reliability.T)
        total = r[:, 0] + r[:, 1] + 1e-8
        return np.clip(r[:, 0] / total * p[:, 0] + r[:, 1] / total * p[:, 1], 0.0, 1.0), np.abs(r[:, 0] - r[:, 1])

    @property
    def best(self) -> str:
        return EXPERTS[0] if self.mcc[EXPERTS[0]] >= self.mcc[EXPERTS[1]] else EXPERTS[1]

    def fused(self, raw: np.ndarray) -> np.ndarray:
        """All of ``FUSED``, (rows, methods)."""
        p = self.calibrated(raw)
        fixed, (adaptive, gap) = self.mixed(p), self.trusted(p)
        columns = {
            "temporal": p[:, 0], "spectral": p[:, 1], "best_individual": p[:, EXPERTS.index(self.best)], "fixed_50": (p[:, 0] + p[:, 1]) / 2.0,
            "best_fixed": fixed, "adaptive": adaptive, "conservative": np.where(gap < self.delta, fixed, adaptive),
        }
        return np.column_stack([columns[m] for m in FUSED])


def _parts(r: dict, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = numbers(r, "x", np.float64, 3), numbers(r, "y", np.float64)
    return x[:, :2], y, numbers(r, "train", np.uint8, models).astype(bool)


def _newton_fit(blocks: Blocks, beta: dict, penalty: np.ndarray, sums, steps: int = 50, tolerance: float = 1e-6) -> None:
    """Newton steps for ``beta`` (by model and expert), in place; models in ``beta`` are fitted."""
    todo = set(beta)
    for _ in range(steps):
        if not todo:
            return
        open_models = sorted({m for m, _ in todo})

        def work(r: dict) -> Iterator[tuple[int, np.ndarray]]:
            yield from sums(r, open_models, beta)

        size = len(penalty) + len(penalty) * (len(penalty) + 1) // 2
        for m, found in sum_over_blocks(blocks, _NUMBERS, work, blocks.shape.models).items():
            for e in range(len(EXPERTS)):
                if (m, e) in todo:
                    after = _newton(found[e * size : (e + 1) * size], beta[m, e], penalty)
                    if np.abs(after - beta[m, e]).max() < tolerance:
                        todo.discard((m, e))
                    beta[m, e] = after
    if todo:
        raise RuntimeError(f"logistic models did not converge in {steps} steps")


def fit_meta(blocks: Blocks) -> list[MetaModel]:
    models, columns = blocks.shape.models, _NUMBERS

    def classes(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        _, y, train = _parts(r, models)
        for m in range(models):
            yield m, np.array([train[:, m].sum(), (y[train[:, m]] == 1).sum()], float)

    size = sum_over_blocks(blocks, columns, classes, models)
    fixed = lambda n, p: -40.0 if p == 0 else 40.0 if p == n else None
    zero = np.zeros(2)
    platt = {(m, e): np.array([fixed(*size.get(m, zero)) or 0.0, 0.0]) for m in range(models) for e in range(2)}

    def platt_sums(r: dict, todo: list[int], beta: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, y, train = _parts(r, models)
        z = logit(raw)
        for m in todo:
            rows = train[:, m]
            one = np.ones(rows.sum())
            yield m, np.concatenate([newton_sums(np.column_stack([one, z[rows, e]]), y[rows], beta[m, e], (1.0, 1.0)) for e in range(2)])

    free = {k: b for k, b in platt.items() if fixed(*size.get(k[0], zero)) is None}
    _newton_fit(blocks, free, np.array([0.0, 1.0]), platt_sums)
    platt |= free
    out = [
        MetaModel(np.stack([platt[m, 0], platt[m, 1]]), {}, {}, 0.5, np.zeros(INPUTS), np.ones(INPUTS), np.zeros((2, INPUTS + 1)))
        for m in range(models)
    ]
    weights = np.arange(POINTS) / float(POINTS - 1)

    def curves(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, y, train = _parts(r, models)
        for m, model in enumerate(out):
            rows = train[:, m]
            p, t = model.calibrated(raw[rows]), y[rows]
            tried = [p[:, 0], p[:, 1], (p[:, 0] + p[:, 1]) / 2.0, *[w * p[:, 0] + (1.0 - w) * p[:, 1] for w in weights]]
            yield m, np.concatenate([counted(v, t) for v in tried])

    empty = np.zeros((3 + POINTS) * 2 * CELLS)
    found = sum_over_blocks(blocks, columns, curves, models)
    for m, model in enumerate(out):
        best = [best_threshold(c) for c in np.split(found.get(m, empty), 3 + POINTS)]
        for name, (cut, mcc) in zip((*EXPERTS, "fixed_50"), best):
            model.cuts[name], model.mcc[name] = cut, mcc
        w = min(range(POINTS), key=lambda i: (-best[3 + i][1], abs(2 * i - (POINTS - 1)), i))
        model.weight, model.cuts["best_fixed"] = float(weights[w]), best[3 + w][0]
        model.cuts["best_individual"] = model.cuts[model.best]
    _fit_reliability(blocks, out)

    def gaps(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, y, train = _parts(r, models)
        for m, model in enumerate(out):
            rows = train[:, m]
            p, t = model.calibrated(raw[rows]), y[rows]
            mix, (adaptive, gap) = model.mixed(p), model.trusted(p)
            yield m, np.concatenate([counted(v, t) for v in (adaptive, *[np.where(gap < d, mix, adaptive) for d in DELTAS])])

    found = sum_over_blocks(blocks, columns, gaps, models)
    for m, model in enumerate(out):
        best = [best_threshold(c) for c in np.split(found.get(m, np.zeros((1 + len(DELTAS)) * 2 * CELLS)), 1 + len(DELTAS))]
        model.cuts["adaptive"] = best[0][0]
        d = min(range(len(DELTAS)), key=lambda i: (-best[1 + i][1], DELTAS[i]))
        model.delta, model.cuts["conservative"] = float(DELTAS[d]), best[1 + d][0]
    return out


def _fit_reliability(blocks: Blocks, out: list[MetaModel]) -> None:
    """Balanced, standardised logistic models of "the expert is right"."""
    models = len(out)

    def means(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, y, train = _parts(r, models)
        for m, model in enumerate(out):
            p = model.calibrated(raw[train[:, m]])
            yield m, np.concatenate([[len(p)], model.right(p, y[train[:, m]]).sum(axis=0), inputs_of(p).sum(axis=0)])

    right = {}
    for m, sums in sum_over_blocks(blocks, _NUMBERS, means, models).items():
        right[m] = sums[:3]
        out[m].centre = sums[3:] / max(sums[0], 1.0)

    def squares(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, _, train = _parts(r, models)
        for m, model in enumerate(out):
            yield m, ((inputs_of(model.calibrated(raw[train[:, m]])) - model.centre) ** 2).sum(axis=0)

    for m, sums in sum_over_blocks(blocks, _NUMBERS, squares, models).items():
        variance = sums / max(right[m][0], 1.0)
        out[m].spread = np.where(variance > 1e-24, np.sqrt(variance), 1.0)
    beta, balance = {}, {}
    for m in range(models):
        n, *hits = right.get(m, np.zeros(3))
        for e, hit in enumerate(hits):
            if hit in (0, n):
                out[m].reliability[e, 0] = -40.0 if hit == 0 else 40.0
                balance[m, e] = (1.0, 1.0)
            else:
                beta[m, e], balance[m, e] = np.zeros(INPUTS + 1), (n / (2.0 * (n - hit)), n / (2.0 * hit))

    def sums_of(r: dict, todo: list[int], beta: dict) -> Iterator[tuple[int, np.ndarray]]:
        raw, y, train = _parts(r, models)
        for m in todo:
            p = out[m].calibrated(raw[train[:, m]])
            x, ok = out[m].design(p), out[m].right(p, y[train[:, m]])
            yield m, np.concatenate([newton_sums(x, ok[:, e], beta.get((m, e), out[m].reliability[e]), balance[m, e]) for e in range(2)])

    _newton_fit(blocks, beta, np.append(0.0, np.ones(INPUTS)), sums_of)
    for (m, e), b in beta.items():
        out[m].reliability[e] = b


def meta_fusion(
    oof: DataFrame, held: DataFrame | None, a: str = "p_temporal", b: str = "p_spectral", target: str = "target",
    fold: str = "fold", keys: Sequence[str] = ("sample_id",), by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(long predictions: keys, target, split, model, method, probability, threshold; components: one row
    per model).

    ``by`` (dataset, seed) names columns whose values are fused each on its own; held rows whose value has
    no out-of-fold rows are left out. Probabilities that are null or not finite raise.
    """
    spark = oof.sparkSession
    every = [*keys, *by]
    seen = oof.select(*by, F.col(fold).cast("int").alias("_fold")).distinct().collect()
    groups = sorted({tuple(r[: len(by)]) for r in seen}, key=repr)
    folds = sorted({int(r["_fold"]) for r in seen})
    named = [(g, f) for g in groups for f in [*folds, FINAL]]

    def of_group(g: tuple):
        same = F.lit(True)
        for c, v in zip(by, g):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        return same

    def taken(df: DataFrame, fold_of, split: str) -> DataFrame:
        return df.select(
            *every, target, fold_of.cast("int").alias("_fold"), F.col(a).cast("double").alias("raw_temporal"),
            F.col(b).cast("double").alias("raw_spectral"), F.lit(split).alias("split"),
        )

    rows = taken(oof, F.col(fold), "train_oof")
    if held is not None:
        rows = rows.unionByName(taken(held, F.lit(None), "validation"))
    place = F.lit(None).cast("double")
    for i, (g, f) in enumerate(named):
        mine = of_group(g) & (F.col("_fold").isNull() if f == FINAL else F.col("_fold") == f)
        place = F.when(mine, F.lit(float(i))).otherwise(place)
    rows = rows.withColumn("_place", place).where("_place IS NOT NULL")
    names = ("raw_temporal", "raw_spectral", "_place")
    fits = [Fit(names, of_group(g) & F.col("_fold").isNotNull() & (F.col("_fold") != f)) for g, f in named]
    blocks = to_blocks(rows, keys[0], target, fits)
    models = fit_meta(blocks)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for r in rows_of([batch]):
                x = numbers(r, "x", np.float64, 3)
                out = np.empty((len(x), len(FUSED)))
                for m in np.unique(x[:, 2]).astype(int).tolist():
                    out[x[:, 2] == m] = models[m].fused(x[x[:, 2] == m, :2])
                scores.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(scores, pa.binary())], ["kept", "score"])

    shape = Shape(names, len(FUSED), ())
    fused = unpack(blocks.table.select("kept", "x").mapInArrow(apply, "kept binary, score binary"), Blocks(blocks.table, shape, blocks.kept))
    cuts = [(float(i), f, [models[i].cuts[m] for m in FUSED]) for i, (_, f) in enumerate(named)]
    table = spark.createDataFrame(cuts, "_place double, model int, cuts array<double>")
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in FUSED]).alias("method"), F.col("scores").alias("probability"), F.col("cuts").alias("threshold")))
    long = fused.join(F.broadcast(table), "_place").select(*every, target, "split", "model", pairs.alias("r"))  # one row per model
    long = long.select(*every, target, "split", "model", "r.method", "r.probability", "r.threshold")
    return long, _components(spark, oof, by, named, models)


def _components(spark, oof: DataFrame, by: Sequence[str], named: list, models: list[MetaModel]) -> DataFrame:
    tuned = (*EXPERTS, "fixed_50")
    rows = [
        (*g, f, *[v for e in tuned for v in (m.cuts[e], m.mcc[e])], m.weight, m.cuts["best_fixed"], m.best, m.cuts["best_individual"], m.cuts["adaptive"], m.delta, m.cuts["conservative"])
        for (g, f), m in zip(named, models)
    ]
    kinds = [f"{c} {oof.schema[c].dataType.simpleString()}" for c in by]
    kinds += ["model int", *[f"{e}_{k} double" for e in tuned for k in ("cut", "mcc")], "weight double", "best_fixed_cut double"]
    kinds += ["best_individual string", "best_individual_cut double", "adaptive_cut double", "delta double", "conservative_cut double"]
    return spark.createDataFrame(rows, ", ".join(kinds))
