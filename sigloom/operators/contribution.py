"""What families of features contribute: every feature set, classifier, mode and seed together.

A mode prepares its table once, with one fold column for each seed, and the tables of all modes stand
in one. The models of all modes, sets, seeds and folds, and the final ones, are fitted by each
classifier in the same passes; thresholds come from the
out-of-fold scores of their own (classifier, mode, set, seed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators.blocks import Fit
from sigloom.operators.boosting import BoostSpec, fit_boosted, held_out_score
from sigloom.operators.linear import LinearSpec, fit_linear
from sigloom.operators.metrics import binary_metrics
from sigloom.operators.models import finite_fill
from sigloom.operators.projections import column_medians, union_results
from sigloom.operators.splits import group_table, stratified_folds
from sigloom.operators.sweeps import select_threshold
from sigloom.session import cut_lineage

CLASSIFIERS = ("logistic", "boosted")
RUN = ("classifier", "mode", "feature_set", "seed")


def mode_columns(df: DataFrame, features: Sequence[str], mode: str, group: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table of a mode and the columns that stand for each feature in it."""
    from sigloom.operators.audits import three_phase_features

    if mode == "phase_independent":
        return df, {f: [f] for f in features}
    if mode != "measurement_aware":
        raise ValueError(f"unknown mode {mode}")
    wide = three_phase_features(df, list(features), group=group)
    ends = {f: [c for c in wide.columns if c.startswith("phase_") and c.endswith(f"_{f}") and len(c) == len(f) + 8] for f in features}
    return wide, ends


def stacked_modes(frames: dict[str, DataFrame], every: Sequence[str], seeds: Sequence[int], folds: int, group: str):
    """(rows of all modes in one table, columns of each mode and feature). A row carries its mode, its
    fold for every seed, and 0 in the columns of other modes, whose models it never meets."""
    out, places = None, {}
    for i, (mode, frame) in enumerate(frames.items()):
        df, columns = mode_columns(frame, every, mode, group)
        df = df.where(F.col("split").isin("train", "validation"))
        train = df.where("split = 'train'")
        flat = [c for cols in columns.values() for c in cols]
        medians = column_medians(train, flat)
        units = group_table(train, group)
        for s in seeds:
            units = stratified_folds(units, folds, s, ["_stratum"], group, f"_fold_{s}")
        units = units.select(F.col(group).alias("_group"), *[f"_fold_{s}" for s in seeds])
        filled = finite_fill(df, medians).join(units, F.col(group) == F.col("_group"), "left")
        places |= {(mode, f): [f"_m{i}_{c}" for c in cols] for f, cols in columns.items()}
        named = filled.select(
            "sample_id", group, "phase", "split", "target", F.lit(mode).alias("mode"), F.concat_ws("|", F.lit(mode), F.col("sample_id").cast("string")).alias("_row"),
            *[f"_fold_{s}" for s in seeds], *[F.col(c).alias(f"_m{i}_{c}") for c in flat],
        )
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return cut_lineage(out.na.fill(0.0, [c for cols in places.values() for c in cols])), places


def family_predictions(
    frames: dict[str, DataFrame], sets: dict[str, Sequence[str]], seeds: Sequence[int], classifiers: Sequence[str] = CLASSIFIERS,
    folds: int = 5, group: str = "id_measurement", boost: BoostSpec = BoostSpec(), linear: LinearSpec = LinearSpec(),
) -> DataFrame:
    """One row per run (classifier, mode, feature_set, seed) and signal: split, target, probability,
    threshold, prediction. ``frames`` has the table of each mode: sample_id, group, phase, target,
    split (train, validation) and the features.

    Train rows carry the score of the model that never saw their fold, validation rows that of the
    model fitted on all train rows. Missing values become the medians of the train rows.
    """
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    rows, places = stacked_modes(frames, every, seeds, folds, group)
    fits, first = [], {}
    for mode in frames:
        mine = (F.col("mode") == mode) & (F.col("split") == "train")
        for label, cols in sets.items():
            used = tuple(c for f in cols for c in places[mode, f])
            for s in seeds:
                first[mode, label, s] = len(fits)
                fits += [Fit(used, mine & (F.col(f"_fold_{s}") != f)) for f in range(folds)]
            first[mode, label, None] = len(fits)
            fits.append(Fit(used, mine))

    def runs(mode: str, classifier: str) -> Column:
        of_train = F.col("split") == "train"
        one = lambda label, s: F.struct(
            F.lit(classifier).alias("classifier"), F.lit(label).alias("feature_set"), F.lit(s).alias("seed"),
            F.when(of_train, held_out_score(f"_fold_{s}", range(folds), offset=first[mode, label, s]))
            .otherwise(F.get("scores", F.lit(first[mode, label, None]))).alias("probability"),
        )
        return F.array(*[one(label, s) for label in sets for s in seeds])

    fitters = {"boosted": lambda: fit_boosted(rows, "_row", "target", fits, boost), "logistic": lambda: fit_linear(rows, "_row", "target", fits, linear)}
    parts = []
    for classifier in classifiers:
        if classifier not in fitters:
            raise ValueError(f"unknown classifier {classifier}")
        scored, _ = fitters[classifier]()
        own = None
        for mode in frames:
            own = F.when(F.col("mode") == mode, runs(mode, classifier)).otherwise(own) if own is not None else F.when(F.col("mode") == mode, runs(mode, classifier))
        parts.append(scored.select("sample_id", group, "phase", "split", "target", "mode", F.explode(own).alias("r")).select("*", "r.*").drop("r"))
    long = cut_lineage(union_results(*parts))
    cuts = select_threshold(long.where("split = 'train'"), list(RUN), tie="first").select(*RUN, "threshold")
    return long.join(F.broadcast(cut_lineage(cuts)), list(RUN)).withColumn(  # one row per run
        "prediction", (F.col("probability") >= F.col("threshold")).cast("int")
    )


def family_metrics(predictions: DataFrame) -> DataFrame:
    """One row per run: the metrics of its validation rows."""
    held = predictions.where("split = 'validation'")
    return binary_metrics(held, list(RUN), prediction="prediction")


def family_deltas(metrics: DataFrame) -> DataFrame:
    """Per (classifier, mode, seed): gain of T, of C, of C given T and of T given C in MCC."""
    by = ["classifier", "mode", "seed"]
    wide = metrics.groupBy(*by).pivot("feature_set", ["S", "S+T", "S+C", "S+T+C"]).agg(F.first("mcc"))
    s, st, sc, stc = (F.col(f"`{c}`") for c in ("S", "S+T", "S+C", "S+T+C"))
    return wide.select(
        *by, (st - s).alias("delta_t"), (sc - s).alias("delta_c"), (stc - st).alias("delta_c_given_t"), (stc - sc).alias("delta_t_given_c")
    )
