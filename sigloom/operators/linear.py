"""Logistic models of many feature sets, folds and seeds, fitted in the same Newton passes over blocks.

``models.fit_logistic`` serves many keys of one feature list; here the models differ in features and
rows, and a row may train any number of them. A pass gives, for every model, one array of gradient and
curvature, added by model; the driver holds only coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigloom.operators.blocks import Blocks, Fit, model_moments, numbers, rows_of, sum_over_blocks, to_blocks, unpack
from sigloom.operators.models import _newton


@dataclass(frozen=True)
class LinearSpec:
    """Balanced classes and a penalty l2 / 2 * |w|^2 on standardised features."""

    l2: float = 1.0
    steps: int = 50
    tolerance: float = 1e-6


@dataclass
class Linear:
    columns: tuple[tuple[int, ...], ...]
    centre: np.ndarray
    spread: np.ndarray
    beta: list[np.ndarray]

    def inputs(self, x: np.ndarray, m: int) -> np.ndarray:
        c = list(self.columns[m])
        return np.column_stack([np.ones(len(x)), (x[:, c] - self.centre[m, c]) / self.spread[m, c]])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([self.inputs(x, m) @ b for m, b in enumerate(self.beta)])
        return 1 / (1 + np.exp(-np.clip(z, -40.0, 40.0)))


def fit_linear(
    df: DataFrame, key: str, target: str, fits: Sequence[Fit], spec: LinearSpec = LinearSpec(), name: str = "scores"
) -> tuple[DataFrame, Linear]:
    """(``df`` with the array ``name``: the probability of class 1 by every model of ``fits``, models).

    A model whose rows are all of one class gives that constant. Models that are not there after
    ``steps`` raise.
    """
    blocks = to_blocks(df, key, target, fits)
    d, models = len(blocks.shape.features), blocks.shape.models
    fit = Linear(blocks.shape.columns, np.zeros((models, d)), np.ones((models, d)), [np.zeros(len(c) + 1) for c in blocks.shape.columns])
    weights, todo = np.ones((models, 2)), set()
    for b in fit.beta:
        b[0] = -40.0
    for r in model_moments(blocks):
        m, n, p = r["model"], r["n"], r["p"]
        std = np.sqrt(np.array(r["m2"]) / n)
        fit.centre[m], fit.spread[m] = r["mean"], np.where(std > 0, std, 1.0)
        fit.beta[m][0] = -40.0 if p == 0 else 40.0 if p == n else 0.0
        if 0 < p < n:
            weights[m] = n / (2.0 * (n - p)), n / (2.0 * p)
            todo.add(m)
    for _ in range(spec.steps):
        if not todo:
            break
        for m, sums in _pass(blocks, fit, weights, todo).items():
            before = fit.beta[m]
            fit.beta[m] = _newton(sums, before, np.append(0.0, np.full(len(before) - 1, spec.l2)))
            if np.abs(fit.beta[m] - before).max() < spec.tolerance:
                todo.discard(m)
    if todo:
        raise RuntimeError(f"logistic models did not converge in {spec.steps} steps")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [fit.probabilities(numbers(r, "x", np.float64, d)).tobytes() for r in rows_of([batch])]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(scores, pa.binary())], ["kept", "score"])

    scored = blocks.table.select("kept", "x").mapInArrow(score, "kept binary, score binary")
    return unpack(scored, blocks, name), fit


def newton_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Gradient, then the upper triangle of the curvature; ``weights`` of class 0 and 1."""
    q = 1 / (1 + np.exp(-np.clip(x @ beta, -40.0, 40.0)))
    w = np.asarray(weights)[(y == 1).astype(int)]
    return np.concatenate([x.T @ (w * (q - y)), ((x.T * (w * q * (1 - q))) @ x)[np.triu_indices(x.shape[1])]])


def _pass(blocks: Blocks, fit: Linear, weights: np.ndarray, todo: set[int]) -> dict[int, np.ndarray]:
    """Newton sums of every model that is not there yet."""
    d, models, active = len(blocks.shape.features), blocks.shape.models, sorted(todo)

    def work(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        x, y = numbers(r, "x", np.float64, d), numbers(r, "y", np.float64)
        train = numbers(r, "train", np.uint8, models).astype(bool)
        for m in active:
            yield m, newton_sums(fit.inputs(x[train[:, m]], m), y[train[:, m]], fit.beta[m], weights[m])

    return sum_over_blocks(blocks, ["x", "y", "train"], work, len(active))
