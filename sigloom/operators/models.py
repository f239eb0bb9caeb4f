"""Cross-fitted models.

Logistic models (calibration, reliability, stacking, gates, features) are fitted for all folds
at once: each Newton step is one aggregation of gradient and curvature per model, and the small
systems are solved in a table. Tree and neural models use MLlib, one fit per fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.confusion import confusion_counts, rates
from sigloom.functions.fusion import reliability_features
from sigloom.functions.scalars import is_finite, logit, sigmoid
from sigloom.operators.checks import require
from sigloom.operators.metrics import brier, ranking_metrics
from sigloom.operators.ordering import attach
from sigloom.operators.projections import column_medians, finite, union_results
from sigloom.operators.splits import grouped_folds
from sigloom.operators.sweeps import best_row, override_curve, select_tau, select_threshold
from sigloom.session import cut_lineage, spread_and_cut

# Logistic regression for many keys at once ---------------------------------------------


#: A coefficient table of at most so many rows is joined by broadcast, a larger one by shuffle.
BROADCAST_MODELS = 1_000
#: Up to so many features, Newton sums are plain aggregates; beyond, tasks sum matrix blocks.
NATIVE_FEATURES = 12


def _join_models(df: DataFrame, table: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Columns of the per-key table, added to the rows of its key."""
    renamed = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    return df.join(F.broadcast(renamed) if small else renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


@dataclass(frozen=True)
class LogisticModels:
    """Coefficients of every key: a table of the keys and ``_coef``, intercept first."""

    keys: tuple[str, ...]
    features: tuple[str, ...]
    table: DataFrame
    small: bool

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Adds P(class 1); null for a key without a model."""
        z = F.get("_coef", F.lit(0))
        for i, f in enumerate(self.features):
            z = z + F.get("_coef", F.lit(i + 1)) * F.col(f)
        if not self.keys:  # one model: features + 1 numbers
            row = self.table.first()
            if row is None:
                raise ValueError("no rows to fit")
            joined = df.withColumn("_coef", F.array(*[F.lit(float(v)) for v in row["_coef"]]))
        else:
            joined = _join_models(df, self.table.select(*self.keys, "_coef"), self.keys, self.small)
        return joined.withColumn(name, sigmoid(z)).drop("_coef")


def fit_logistic(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, l2: float = 1.0,
    balanced: bool = False, scale: bool = False, steps: int = 50, tolerance: float = 1e-6, held_out: str | None = None,
) -> LogisticModels:
    """Penalised logistic regression (sum of losses + l2/2 * |w|^2) for every key.

    Newton steps converge quadratically, so a last step below 1e-6 leaves an error near 1e-12;
    models that are not there after ``steps`` raise, and so do non-finite features. A key whose
    rows are all of one class gets that constant. ``balanced`` weights classes inversely to
    their counts; ``scale`` penalises the coefficients of standardised features.

    With ``held_out``, the column of that name is one more key, and its model is fitted on the
    rows of all its *other* values: every row serves those models from where it lies, and no
    copies are stored.

    Coefficients are a table that is joined to the rows for each step. Of few small models it is
    held by the driver, which is at most ``BROADCAST_MODELS`` rows of ``NATIVE_FEATURES`` numbers
    and their products; else it stays in the cluster, and the driver sees two counts. The shift of a feature is absorbed by the
    intercept, which is not penalised, so features are centred once for all keys.
    """
    keys, features, d = list(keys), list(features), len(features)
    named = tuple([*keys, *([held_out] if held_out else [])])
    if not named:  # one model: a key of one value
        keys, df = ["_all"], df.withColumn("_all", F.lit(0))
    every = [*keys, *([held_out] if held_out else [])]
    sound = F.lit(True)
    for f in features:
        sound = sound & F.coalesce(is_finite(f), F.lit(False))
    checked = require(df, sound, "a feature is null or not finite")
    whole = checked.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    centre = [whole[f"m{i}"] or 0.0 for i in range(d)]
    spread = [whole[f"s{i}"] or 1.0 for i in range(d)]
    xs = [((F.col(f) - F.lit(float(m))) / F.lit(float(s))).alias(f"_x{i}") for i, (f, m, s) in enumerate(zip(features, centre, spread))]
    names = [f"_x{i}" for i in range(d)]
    rows = spread_and_cut(checked.select(*every, *xs, F.col(target).cast("double").alias("_y")))
    state = _start(rows, keys, held_out, names, [l2 / s**2 for s in spread], l2 if scale else None, balanced)
    count = state.count()
    small = count <= BROADCAST_MODELS
    sums = _native_sums if d <= NATIVE_FEATURES else _block_sums

    def gathered(state: DataFrame) -> DataFrame:
        active = state.where(~F.col("_done")).select(*every, "_beta", "_w0", "_w1")
        return sums(_serve(rows, active, keys, held_out, small), every, names)

    if small and d <= NATIVE_FEATURES:
        # At most BROADCAST_MODELS * 105 numbers: one job for each step, solved where it ends.
        state = _solve_few(state, gathered, every, d, steps, tolerance)
    else:
        for _ in range(steps):
            state = cut_lineage(_moved(state, gathered(state), every, d, tolerance, small))
            if not state.where(~F.col("_done")).limit(1).count():
                break
        else:
            raise RuntimeError(f"logistic models did not converge in {steps} steps")
    raw = F.transform(F.slice("_beta", 2, max(d, 1)), lambda b, i: b / F.get(F.array(*[F.lit(float(s)) for s in spread]), i))
    shift = sum((F.get("_beta", F.lit(i + 1)) * F.lit(float(m / s)) for i, (m, s) in enumerate(zip(centre, spread))), F.lit(0.0))
    table = state.select(*every, F.concat(F.array(F.get("_beta", F.lit(0)) - shift), raw).alias("_coef"))
    return LogisticModels(named, tuple(features), cut_lineage(table.drop("_all")), small)


def _serve(rows: DataFrame, models: DataFrame, keys: Sequence[str], held_out: str | None, small: bool) -> DataFrame:
    """Each row with every model that it trains: of its key, and of the other held-out values."""
    side = models.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in models.columns if c not in keys])
    side = side.withColumnRenamed(held_out, "_held") if held_out else side
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + ([F.col(held_out) != F.col("_held")] if held_out else [])
    if held_out and not keys and not small:
        raise ValueError(f"more than {BROADCAST_MODELS} held-out values need a key")
    joined = rows.join(F.broadcast(side) if small else side, on).drop(*[f"_k_{k}" for k in keys])
    return joined.drop(held_out).withColumnRenamed("_held", held_out) if held_out else joined


def _start(
    rows: DataFrame, keys: Sequence[str], held_out: str | None, names: Sequence[str], plain: Sequence[float],
    scaled: float | None, balanced: bool,
) -> DataFrame:
    """Class weights, penalties and zero coefficients of every model. What a model with a held-out
    value sees is the key's total less that value's part. The penalties are ``plain``, or
    ``scaled`` times the variance of the feature in the model's rows, unless it is constant."""
    every = [*keys, *([held_out] if held_out else [])]
    sums = [F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p")]
    sums += [F.sum(c).alias(f"_a{i}") for i, c in enumerate(names)] + [F.sum(F.col(c) * F.col(c)).alias(f"_b{i}") for i, c in enumerate(names)]
    stats = rows.groupBy(*every).agg(*sums)
    if held_out:
        columns = [c for c in stats.columns if c not in every]
        totals = stats.groupBy(*keys).agg(*[F.sum(c).alias(f"_t{c}") for c in columns])
        stats = attach(stats, totals, keys).select(*every, *[(F.col(f"_t{c}") - F.col(c)).alias(c) for c in columns]).where("_n > 0")
    n, pos = F.col("_n").cast("double"), F.col("_p")
    one_class = (pos == 0) | (pos == n)
    weights = [F.when(one_class | F.lit(not balanced), F.lit(1.0)).otherwise(n / (2.0 * m)) for m in (n - pos, pos)]
    variance = [F.greatest(F.col(f"_b{i}") / n - F.pow(F.col(f"_a{i}") / n, 2), F.lit(0.0)) for i in range(len(names))]
    penalty = [F.lit(p) if scaled is None else F.when(v > 1e-24, v * scaled).otherwise(F.lit(p)) for p, v in zip(plain, variance)]
    first = F.when(pos == 0, F.lit(-40.0)).when(pos == n, F.lit(40.0)).otherwise(F.lit(0.0))
    return cut_lineage(
        stats.select(
            *every,
            F.concat(F.array(first), F.array_repeat(F.lit(0.0), len(names))).alias("_beta"),
            F.array(F.lit(0.0), *penalty).alias("_penalty"),
            weights[0].alias("_w0"), weights[1].alias("_w1"), one_class.alias("_done"),
        )
    )


def _native_sums(served: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Gradient, then the upper triangle of the curvature, as plain aggregates."""
    z = F.get("_beta", F.lit(0))
    for i, c in enumerate(names):
        z = z + F.get("_beta", F.lit(i + 1)) * F.col(c)
    q = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
    w = F.when(F.col("_y") == 1, F.col("_w1")).otherwise(F.col("_w0"))
    terms = served.select(*keys, *names, "_y", w.alias("_w"), q.alias("_q")).select(
        *keys, *names, (F.col("_w") * (F.col("_q") - F.col("_y"))).alias("_g"), (F.col("_w") * F.col("_q") * (1 - F.col("_q"))).alias("_c")
    )
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    parts = [F.sum(F.col("_g") * v) for v in x] + [F.sum(F.col("_c") * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    return terms.groupBy(*keys).agg(F.array(*parts).alias("_sums"))


def _block_sums(served: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The same for many features: tasks multiply blocks of rows, and one array for each task and
    key is added up number by number."""
    keys, names = list(keys), list(names)
    upper = np.triu_indices(len(names) + 1)
    kinds = dict(served.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                y, beta = part["_y"].to_numpy(), np.asarray(part["_beta"].iloc[0])
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                q = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40.0, 40.0)))
                w = np.where(y == 1, part["_w1"].iloc[0], part["_w0"].iloc[0])
                flat = np.concatenate([x.T @ (w * (q - y)), ((x.T * (w * q * (1 - q))) @ x)[upper]])
                held[key] = held.get(key, 0.0) + flat
        if held:
            yield pd.DataFrame(list(held), columns=keys).assign(sums=list(held.values()))

    keyed = "".join(f"{k} {kinds[k]}, " for k in keys)
    partial = served.select(*keys, *names, "_y", "_beta", "_w0", "_w1").mapInPandas(run, keyed + "sums array<double>")
    added = partial.select(*keys, F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("_sums")
    return added.groupBy(*keys).agg(ordered)


def _newton(sums: np.ndarray, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coefficients after one step, which is cut to 4 in its largest number."""
    size = len(beta)
    curve = np.zeros((size, size))
    curve[np.triu_indices(size)] = sums[size:]
    curve = curve + np.triu(curve, 1).T + np.diag(penalty) + 1e-10 * np.eye(size)
    move = np.linalg.solve(curve, sums[:size] + penalty * beta)
    return beta - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-300))


def _solve_few(
    state: DataFrame, gathered: Callable[[DataFrame], DataFrame], keys: Sequence[str], d: int, steps: int, tolerance: float
) -> DataFrame:
    schema, models = state.schema, [r.asDict() for r in state.collect()]

    def table() -> DataFrame:
        return state.sparkSession.createDataFrame([tuple(m[c] for c in schema.names) for m in models], schema)

    for _ in range(steps):
        if all(m["_done"] for m in models):
            break
        sums = {tuple(r[k] for k in keys): np.asarray(r["_sums"]) for r in gathered(table()).collect()}
        for m in models:
            found = sums.get(tuple(m[k] for k in keys))
            if m["_done"] or found is None:
                continue
            before = np.asarray(m["_beta"])
            after = _newton(found, before, np.asarray(m["_penalty"]))
            m["_beta"], m["_done"] = after.tolist(), bool(np.abs(after - before).max() < tolerance)
    if not all(m["_done"] for m in models):
        raise RuntimeError(f"logistic models did not converge in {steps} steps")
    return table()


def _moved(state: DataFrame, found: DataFrame, keys: Sequence[str], d: int, tolerance: float, small: bool) -> DataFrame:
    """One Newton step of every unfinished model."""

    @F.pandas_udf("array<double>")
    def step(sums: pd.Series, beta: pd.Series, penalty: pd.Series) -> pd.Series:
        out = []
        for s, b, p in zip(sums, beta, penalty):
            if s is None:
                out.append(b)
                continue
            out.append(_newton(np.asarray(s), np.asarray(b), np.asarray(p)))
        return pd.Series(out)

    moved = _join_models(state, found, keys, small).withColumn("_next", F.when(F.col("_done"), F.col("_beta")).otherwise(step("_sums", "_beta", "_penalty")))
    size = F.array_max(F.zip_with("_next", "_beta", lambda a, b: F.abs(a - b)))
    return moved.select(*keys, F.col("_next").alias("_beta"), "_penalty", "_w0", "_w1", (F.col("_done") | (size < tolerance)).alias("_done"))


# Calibration and reliability ------------------------------------------------------------


def fit_platt(df: DataFrame, keys: Sequence[str], probability: str, target: str = "target") -> LogisticModels:
    return fit_logistic(df.withColumn("_z", logit(probability)), keys, ["_z"], target)


def apply_platt(df: DataFrame, models: LogisticModels, probability: str, name: str) -> DataFrame:
    return models.score(df.withColumn("_z", logit(probability)), name).drop("_z")


def fit_reliability(df: DataFrame, keys: Sequence[str], features: Sequence[str], correct: str) -> LogisticModels:
    """P(the expert is right), balanced and standardised."""
    return fit_logistic(df, keys, features, correct, balanced=True, scale=True)


def reliability_quality(df: DataFrame, by: Sequence[str], reliability: str, correct: str) -> DataFrame:
    named = df.select(*by, F.col(reliability).alias("probability"), F.col(correct).alias("target"))
    return brier(named, by).join(ranking_metrics(named, by).select(*by, "roc_auc"), list(by))


def select_reliability(quality: DataFrame, by: Sequence[str] = (), extended: str = "extended") -> DataFrame:
    """Lowest Brier, then highest AUC; extended features win only when strictly better."""
    return best_row(quality, by, [F.col("brier"), F.desc("roc_auc"), F.col(extended)])


# MLlib estimators -----------------------------------------------------------------------


def make_estimator(name: str, features: Sequence[str], seed: int, target: str = "target", iterations: int = 50) -> Pipeline:
    """``gbt`` or ``mlp`` behind an assembler and a scaler."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error")
    scale = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
    if name == "gbt":
        model = GBTClassifier(featuresCol="_x", labelCol=target, maxIter=iterations, maxDepth=4, stepSize=0.1, seed=seed)
    elif name == "mlp":
        model = MultilayerPerceptronClassifier(featuresCol="_x", labelCol=target, layers=[len(features), 16, 8, 2], maxIter=iterations, seed=seed)
    else:
        raise ValueError(f"unknown estimator {name}")
    return Pipeline(stages=[assemble, scale, model])


def fit_predict(
    fit: DataFrame, apply: DataFrame, features: Sequence[str], name: str, seed: int, target: str = "target",
    iterations: int = 50, output: str = "probability",
) -> DataFrame:
    """Fit on ``fit``, score ``apply``; one class in ``fit`` gives that constant."""
    if name == "logistic":
        return fit_logistic(fit, [], features, target, balanced=True, scale=True, steps=iterations).score(apply, output)
    classes = [int(r[0]) for r in fit.select(target).distinct().collect()]
    if not classes:
        raise ValueError("no rows to fit")
    if len(classes) < 2:
        return apply.withColumn(output, F.lit(float(classes[0])))
    scored = make_estimator(name, features, seed, target, iterations).fit(fit).transform(apply)
    return scored.withColumn(output, vector_to_array("probability")[1]).select(*apply.columns, output)


def cross_fit(
    df: DataFrame,
    features: Sequence[str],
    estimator: str = "logistic",
    seed: int = 42,
    fold: str = "fold",
    target: str = "target",
    fold_transform: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    iterations: int = 50,
) -> DataFrame:
    """Out-of-fold probabilities: every row is scored once, by a model that never saw its fold.

    ``fold_transform(fit_rows, rows)`` refits any preprocessing on the fit rows only. Logistic
    models of all folds are fitted together; others fold by fold on a stored input.
    """
    if estimator == "logistic" and fold_transform is None:
        return stacking(df, features, fold, target, iterations)
    base = cut_lineage(df)
    folds = sorted(r[0] for r in base.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("cross-fitting needs at least two folds")
    parts, fits = [], []
    for f in folds:
        fit, held = base.where(F.col(fold) != f), base.where(F.col(fold) == f)
        if fold_transform:
            fit, held = fold_transform(fit, fit), fold_transform(fit, held)
        if estimator == "logistic":
            fits.append(fit.withColumn("_model", F.lit(f)))
            parts.append(held)
        else:
            parts.append(fit_predict(fit, held, features, estimator, seed, target, iterations))
    out = union_results(*parts)
    if estimator == "logistic":
        models = fit_logistic(union_results(*fits), ["_model"], features, target, balanced=True, scale=True, steps=iterations)
        out = models.score(out.withColumn("_model", F.col(fold)), "probability").drop("_model")
    return out


def impute_transform(features: Sequence[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Median imputation learned on the fit rows of each fold."""

    def run(fit: DataFrame, rows: DataFrame) -> DataFrame:
        return finite(rows, features, "median", fit=fit)

    return run


BASELINE_MODES = ("phase_independent", "measurement_aware", "measurement_any_positive")


@dataclass(frozen=True)
class PreparedBaseline:
    """Imputed train rows with folds, imputed validation rows, and each feature's columns."""

    train: DataFrame
    held: DataFrame
    columns: dict[str, list[str]]
    mode: str
    group: str


def prepare_baseline(
    df: DataFrame, features: Sequence[str], seed: int = 42, mode: str = "phase_independent",
    group: str = "id_measurement", folds: int = 5,
) -> PreparedBaseline:
    """Impute with train medians and assign group folds, once for any number of feature sets."""
    from sigloom.operators.audits import three_phase_features, to_group_level

    columns = {f: [f] for f in features}
    if mode == "measurement_aware":
        df = three_phase_features(df, list(features), group=group)
        columns = {f: [c for c in df.columns if c.startswith("phase_") and c.endswith(f"_{f}") and len(c) == len(f) + 8] for f in features}
    elif mode == "measurement_any_positive":
        df = to_group_level(df, list(features), group).withColumn("sample_id", F.col(group))
    elif mode != "phase_independent":
        raise ValueError(f"unknown mode {mode}")
    train, held = df.where("split = 'train'"), df.where("split = 'validation'")
    medians = column_medians(train, [c for cols in columns.values() for c in cols])
    folded = grouped_folds(finite_fill(train, medians).drop("fold"), folds, seed, group)
    return PreparedBaseline(spread_and_cut(folded), cut_lineage(finite_fill(held, medians)), columns, mode, group)


def evaluate_baseline(
    prepared: PreparedBaseline, features: Sequence[str], estimator: str = "logistic", seed: int = 42, iterations: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(validation predictions, one metric row): OOF scores pick the threshold, a refit on all
    train rows scores validation."""
    columns = [c for f in features for c in prepared.columns[f]]
    oof = cut_lineage(cross_fit(prepared.train, columns, estimator, seed, iterations=iterations).select("target", "probability"))
    cut = select_threshold(oof, [], tie="first").first()["threshold"]
    scored = fit_predict(prepared.train, prepared.held, columns, estimator, seed, iterations=iterations)
    scored = scored.withColumn("threshold", F.lit(cut)).withColumn(
        "prediction", (F.col("probability") >= F.lit(cut)).cast("int")
    )
    keep = ("sample_id", prepared.group, "phase", "target", "probability", "threshold", "prediction")
    predictions = scored.select(*[c for c in keep if c in scored.columns])
    metrics = predictions.agg(*confusion_counts("target", "prediction"), F.max("threshold").alias("threshold")).select(
        F.lit(prepared.mode).alias("mode"), F.lit(estimator).alias("estimator"), F.lit(seed).alias("seed"), "*", *rates()
    )
    return predictions, metrics


def feature_baseline(
    df: DataFrame, features: Sequence[str], estimator: str = "logistic", seed: int = 42, mode: str = "phase_independent",
    group: str = "id_measurement", folds: int = 5, iterations: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """Impute, cross-fit, choose the threshold on OOF rows, refit, score validation.

    Modes: one row per signal; the three phases' features side by side; or group level with
    an any-positive label.
    """
    prepared = prepare_baseline(df, features, seed, mode, group, folds)
    return evaluate_baseline(prepared, features, estimator, seed, iterations)


def finite_fill(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.lit(m)) for c, m in medians.items()}
    )


def domain_shift(df: DataFrame, features: Sequence[str], seed: int = 42, group: str = "id_measurement", folds: int = 5) -> DataFrame:
    """AUC of telling validation rows from train rows, cross-fitted by group (0.5 = no shift).
    Values that are null or not finite become 0 first."""
    df = df.withColumns({f: F.when(is_finite(f), F.col(f).cast("double")).otherwise(F.lit(0.0)) for f in features})
    named = df.where(F.col("split").isin("train", "validation")).withColumn(
        "target", (F.col("split") == "validation").cast("int")
    )
    folded = grouped_folds(named.drop("fold"), folds, seed, group)
    oof = cut_lineage(cross_fit(folded, features, "logistic", seed))
    return ranking_metrics(oof, []).select("positives", "negatives", "roc_auc")


def stacking(df: DataFrame, features: Sequence[str], fold: str = "fold", target: str = "target", iterations: int = 50) -> DataFrame:
    """Cross-fitted balanced logistic model; all folds are fitted in the same passes."""
    models = fit_logistic(df, [], features, target, balanced=True, scale=True, steps=iterations, held_out=fold)
    return models.score(df, "probability")


def gate_features(a: str, b: str) -> dict[str, Column]:
    """Thirteen inputs of a disagreement gate."""
    base = reliability_features(a, b)
    pa, pb = F.col(a), F.col(b)
    base.pop("agreement")
    return base | {
        "up_a": (pa >= 0.5).cast("double"),
        "up_b": (pb >= 0.5).cast("double"),
        "differ": ((pa >= 0.5) != (pb >= 0.5)).cast("double"),
    }


def disagreement_gate(
    oof: DataFrame, held: DataFrame, a: str, b: str, cut_a: float, cut_b: float, by: Sequence[str] = (), target: str = "target"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored rows, override curve, chosen tau): a model of "b is right", fitted on OOF rows
    where the experts disagree, decides when b's decision replaces a's."""
    inputs = gate_features(a, b)
    names = [f"_g_{n}" for n in inputs]

    def prepared(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_g_{n}": c for n, c in inputs.items()})

    fit = prepared(oof).where("_g_differ = 1").withColumn("_right", ((F.col(b) >= 0.5).cast("int") == F.col(target)).cast("int"))
    models = fit_logistic(fit, by, names, "_right", balanced=True, scale=True)
    scored = models.score(prepared(held), "_s").withColumns(
        {
            "anchor": (F.col(a) >= cut_a).cast("int"),
            "alternative": (F.col(b) >= cut_b).cast("int"),
            "gate_score": F.when(F.col("_g_differ") == 1, F.col("_s")).otherwise(F.lit(0.0)),
        }
    ).drop("_s", *names)
    scored = cut_lineage(scored)
    curve = override_curve(scored, by, target, "anchor", "alternative", "gate_score")
    return scored, curve, select_tau(scored, by, target, "anchor", "alternative", "gate_score", tie="harm")


# Cross-fitted meta fusion ---------------------------------------------------------------

#: The methods of a meta fusion, and the name of the model that is applied to validation rows.
FUSED = ("temporal", "spectral", "best_individual", "fixed_50", "best_fixed", "adaptive", "conservative")
FINAL = -1


# Morphology ----------------------------------------------------------------------------


def morphology(segments: DataFrame, keys: Sequence[str], segment: str, length: int, components: int = 10, clusters: int = 12, seed: int = 42) -> DataFrame:
    """Cluster segments by shape: scale by the largest absolute value, PCA, k-means; polarity
    is the sign at that value. MLlib fits both on the distributed segments."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from sigloom.functions.arrays import peak_abs
    from sigloom.operators.pulses import polarity

    top = F.greatest(peak_abs(segment), F.lit(1e-6))
    rows = segments.withColumn("polarity", polarity(segment)).withColumn("_top", top).withColumn(
        "_v", array_to_vector(F.transform(segment, lambda x: x / F.col("_top")))
    )
    rows = cut_lineage(rows.select(*keys, "polarity", "_v"))
    pca = PCA(k=min(components, length), inputCol="_v", outputCol="_c").fit(rows)
    reduced = pca.transform(rows)
    model = KMeans(k=clusters, seed=seed, featuresCol="_c", predictionCol="cluster", maxIter=20).fit(reduced)
    return model.transform(reduced).select(*keys, "polarity", "cluster")
