"""Contracts, gates and verdicts: rules over small metric tables, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.confusion import confusion_counts, mcc
from sigloom.functions.scalars import is_finite
from sigloom.operators.projections import HOLDOUT_SPLITS

# Columns of a prediction source, and the splits it may hold.
SOURCE_COLUMNS = (
    "sample_id", "id_measurement", "phase", "target", "dataset", "split",
    "method", "seed", "probability", "threshold", "prediction",
)
DEVELOPMENT_SPLITS = ("train_oof", "validation")


def source_contract(
    pred: DataFrame,
    methods: Sequence[str],
    seeds: Sequence[int],
    allow_holdouts: bool = False,
) -> DataFrame:
    """One report row for a prediction source: violation counts and PASS or FAIL.

    Row checks and the (sample, method) fold share one pass; samples fold from there, so
    the table is shuffled once on its own key with map-side combining.
    """
    missing = sorted(set(SOURCE_COLUMNS) - set(pred.columns))
    if missing:
        raise ValueError(f"prediction source lacks columns {missing}")
    allowed = list(DEVELOPMENT_SPLITS) + (list(HOLDOUT_SPLITS[:3]) if allow_holdouts else [])
    p, y = F.col("probability"), F.col("target")
    flags = {
        "unexpected_method": ~F.col("method").isin(*methods),
        "holdout_rows": F.lit(False) if allow_holdouts else F.col("split").isin(*HOLDOUT_SPLITS),
        "unsupported_split": ~F.col("split").isin(*allowed),
        "unexpected_seed": ~F.col("seed").isin(*seeds),
        "non_finite": ~is_finite("probability"),
        "out_of_range": is_finite("probability") & ~p.between(0.0, 1.0),
        "bad_target": y.isNull() | ~y.isin(0, 1),
    }
    key = ["dataset", "seed", "split", "sample_id"]
    per_method = pred.groupBy(*key, "method").agg(
        F.count(F.lit(1)).alias("n"), F.min("target").alias("lo"), F.max("target").alias("hi"),
        *[F.count_if(c).alias(name) for name, c in flags.items()],
    )
    per_sample = per_method.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("n") > 1).alias("repeats"),
        F.count(F.lit(1)).alias("methods"),
        (F.min("lo") != F.max("hi")).alias("labels_differ"),
        *[F.sum(name).alias(name) for name in flags],
    )
    report = per_sample.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("parent_rows"),
        F.count_distinct("seed").alias("seeds"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("methods") != 2).alias("incomplete_pairs"),
        F.count_if(F.col("labels_differ")).alias("inconsistent_labels"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in flags],
    )
    clean = (F.col("rows") > 0) & (F.col("seeds") == len(set(seeds)))
    for name in ["duplicates", "incomplete_pairs", "inconsistent_labels", *flags]:
        clean = clean & (F.col(name) == 0)
    return report.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))


def expert_gate(
    metrics: DataFrame,
    by: Sequence[str],
    methods: Sequence[str],
    mean_min: float,
    seed_min: float,
    seeds: int = 3,
) -> DataFrame:
    """Eligible when every listed method has ``seeds`` rows, a high mean and no weak seed."""
    per = metrics.where(F.col("method").isin(*methods)).groupBy(*by, "method").agg(
        F.avg("mcc").alias("mean_mcc"), F.min("mcc").alias("min_mcc"), F.count("mcc").alias("n")
    )
    ok = (F.col("n") == seeds) & (F.col("mean_mcc") >= mean_min) & (F.col("min_mcc") >= seed_min)
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("methods"),
        F.min("mean_mcc").alias("weakest_mean_mcc"),
        F.min("min_mcc").alias("weakest_seed_mcc"),
        F.count_if(ok).alias("passing"),
    ).withColumn("eligible", F.col("passing") == len(methods)).drop("passing")


def fusion_gate(
    deltas: DataFrame, minimum_delta: float = 0.005, minimum_positive: int = 2, ci_floor: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """Per comparison: mean delta, positive seeds, interval floor and whether it passes.

    ``deltas``: comparison, seed, delta, ci_low (the hierarchical interval, same on each row).
    """
    per = deltas.groupBy(*by, "comparison").agg(
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("positive_seeds"),
        F.max("ci_low").alias("ci_low"),
    )
    passed = (
        (F.col("mean_delta") >= minimum_delta)
        & (F.col("positive_seeds") >= minimum_positive)
        & F.coalesce(F.col("ci_low") > ci_floor, F.lit(False))
    )
    return per.withColumn("passed", passed)


def fusion_eligible(comparisons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return comparisons.groupBy(*by).agg(F.bool_or("passed").alias("eligible"))


def single_score_gate(records: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """STOP / WEAK_DO_NOT_FREEZE / PASS on the best expert's MCC per seed."""
    mean, low = F.col("mean_best"), F.col("minimum_best")
    return records.groupBy(*by).agg(
        F.avg("best_individual_mcc").alias("mean_best"),
        F.min("best_individual_mcc").alias("minimum_best"),
        F.min("minimum_expert_mcc").alias("minimum_expert"),
        F.max("compute_cost").alias("compute_cost"),
    ).withColumn(
        "status",
        F.when(mean <= 0.60, "STOP").when((mean < 0.70) | (low <= 0.60), "WEAK_DO_NOT_FREEZE").otherwise("PASS"),
    )


def two_score_gate(
    records: DataFrame, by: Sequence[str] = ("candidate",), a: str = "temporal_validation_mcc", b: str = "cwt_validation_mcc"
) -> DataFrame:
    """STOP / REVIEW_DO_NOT_FREEZE / PASS on the best and second expert per seed."""
    seeds = records.withColumns({"_best": F.greatest(a, b), "_second": F.least(a, b)})
    mean_best, mean_second, low = F.col("mean_best"), F.col("mean_second"), F.col("minimum_best")
    broken = F.col("broken") > 0
    stop = broken | (low <= 0.60) | (mean_best < 0.60) | (mean_second < 0.60)
    return seeds.groupBy(*by).agg(
        F.avg("_best").alias("mean_best"),
        F.avg("_second").alias("mean_second"),
        F.min("_best").alias("minimum_best"),
        F.min("_second").alias("minimum_second"),
        F.max("compute_cost").alias("compute_cost"),
        F.count_if(~is_finite(a) | ~is_finite(b)).alias("broken"),
    ).withColumn(
        "status",
        F.when(stop, "STOP").when((mean_best < 0.70) | (mean_second < 0.65), "REVIEW_DO_NOT_FREEZE").otherwise("PASS"),
    ).drop("broken")


def select_candidate(decisions: DataFrame, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Best passing candidate: mean, then ``second``, then the lower cost."""
    order = [F.desc("mean_best"), F.desc(second), F.col("compute_cost"), F.col("candidate")]
    ranked = decisions.where("status = 'PASS'").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    )
    return ranked.where("_r = 1").drop("_r")


def select_near_best(rows: DataFrame, tolerance: float) -> DataFrame:
    """Among candidates within ``tolerance`` of the best mean: weakest expert first, then cost."""
    best = rows.agg(F.max("mean_mcc").alias("m")).scalar()
    near = rows.where(F.col("mean_mcc") >= best - F.lit(tolerance))
    return near.orderBy(F.desc("minimum_expert_mcc"), "compute_cost", "candidate").limit(1)


def missing_candidates(records: DataFrame, candidates: Sequence, seeds: Sequence[int]) -> DataFrame:
    """Declared (candidate, seed) pairs without a record."""
    spark = records.sparkSession
    declared = spark.createDataFrame(
        [(c, int(s)) for c in candidates for s in seeds], f"candidate {dict(records.dtypes)['candidate']}, seed int"
    )
    return declared.join(records.select("candidate", "seed"), ["candidate", "seed"], "left_anti")


def verify_stored(stored: DataFrame, manifest: DataFrame, by: Sequence[str] = (), key: str = "sample_id") -> DataFrame:
    """Compare stored predictions with a manifest and rebuild their metric record.

    ``reusable`` is true only when ids and labels agree exactly and every probability is a
    finite value in [0,1]; otherwise the caller recomputes.
    """
    none = F.lit(None)
    s = stored.select(
        *by, key, F.col("target").alias("_y"), none.cast("int").alias("target"), "probability", "threshold",
        F.lit(1).alias("_s"), F.lit(0).alias("_m"),
    )
    m = manifest.select(
        *by, key, none.cast("int").alias("_y"), "target", none.cast("double").alias("probability"),
        none.cast("double").alias("threshold"), F.lit(0).alias("_s"), F.lit(1).alias("_m"),
    )
    # One shuffle on the key, folded map-side; a repeated key is a count, not extra rows.
    per_key = s.unionByName(m).groupBy(*by, key).agg(
        F.sum("_s").alias("_s"), F.sum("_m").alias("_m"), F.max("_y").alias("_y"), F.max("target").alias("target"),
        F.max("probability").alias("probability"), F.max("threshold").alias("threshold"),
        F.count_if((F.col("_s") == 1) & ~(is_finite("probability") & F.col("probability").between(0.0, 1.0))).alias("_bad"),
    )
    p = F.col("probability")
    agg = per_key.groupBy(*by).agg(
        F.count_if(F.col("_s") == 0).alias("missing"),
        F.count_if(F.col("_m") == 0).alias("unexpected"),
        F.count_if(F.col("_y") != F.col("target")).alias("label_mismatch"),
        F.sum("_bad").alias("bad_probability"),
        F.count_if((F.col("_s") > 1) | (F.col("_m") > 1)).alias("repeated"),
        *confusion_counts("target", (p >= F.col("threshold")).cast("int")),
    )
    ok = F.lit(True)
    for c in ("missing", "unexpected", "label_mismatch", "bad_probability", "repeated"):
        ok = ok & (F.col(c) == 0)
    return agg.withColumn("reusable", ok).withColumn("mcc", F.when(F.col("reusable"), mcc()))


# Verdicts -----------------------------------------------------------------------------


def strength_label(value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return (
        F.when(v >= 0.60, "STRONG").when(v >= 0.50, "MEANINGFUL BUT WEAKER").when(v >= 0.40, "WEAK").otherwise("VERY WEAK")
    )


def conditional_label(delta: str, positive: str, negative: str) -> Column:
    """What adding one family to another does, from its mean delta and seed signs."""
    d, up, down = F.col(delta), F.col(positive), F.col(negative)
    return (
        F.when((d <= -0.005) & (down >= 2), "HARMFUL")
        .when((d >= 0.010) & (up >= 2) & (down == 0), "STRONGLY COMPLEMENTARY")
        .when((d >= 0.005) & (up >= 2), "WEAKLY COMPLEMENTARY")
        .when((F.abs(d) < 0.005) | (up < 2), "REDUNDANT / INCONSISTENT")
        .otherwise("NOT SUPPORTED")
    )


def modality_verdict(
    ok: str = "checks_ok", t: str = "temporal", c: str = "cwt", tc: str = "combined",
    delta: str = "delta_c_given_t", positive: str = "positive_seeds", negative: str = "negative_seeds",
) -> Column:
    t, c, tc, d, up, down = (F.col(x) for x in (t, c, tc, delta, positive, negative))
    strongly = (d >= 0.010) & (up >= 2) & (down == 0)
    weakly = (d >= 0.005) & (d < 0.010) & (up >= 2)
    redundant = (F.abs(d) < 0.005) | (up < 2)
    harmful = (d <= -0.005) & (down >= 2)
    undecided = F.lit("REPRESENTATION DECOMPOSITION INCONCLUSIVE")
    return (
        F.when(~F.coalesce(F.col(ok), F.lit(False)), undecided)
        .when((t >= 0.60) & (c >= 0.60) & (tc > F.greatest(t, c)) & strongly, "TEMPORAL+CWT SUPPORTED")
        .when((t >= 0.60) & (c >= 0.50) & (strongly | weakly), "CWT COMPLEMENTARY BUT WEAKER")
        .when((t >= 0.50) & (c >= 0.50) & redundant, "CWT REDUNDANT")
        .when(((c < 0.50) | harmful | (up < 2)) & (d <= 0.005), "CWT NOT SUPPORTED")
        .when((t < 0.50) & (c >= 0.60), "TEMPORAL NOT SUPPORTED")
        .otherwise(undecided)
    )


def cross_dataset_verdict(first: str, second: str, label: str = "SPECTROGRAM") -> Column:
    """Verdict from columns ok, <first>_strong, <second>_strong, complementary (booleans)."""
    a, b, extra = F.col(f"{first}_strong"), F.col(f"{second}_strong"), F.col("complementary")
    return (
        F.when(~F.coalesce(F.col("ok"), F.lit(False)), "INCONCLUSIVE")
        .when(a & b & extra, f"TEMPORAL+{label} SUPPORTED")
        .when(a & ~b, f"{label} SUPPORTED ONLY ON {first.upper()}")
        .when(b & ~a, f"{label} SUPPORTED ONLY ON {second.upper()}")
        .when((a | b) & ~extra, f"{label} NOT COMPLEMENTARY")
        .otherwise(f"{label} NOT SUPPORTED")
    )


def full_signal_verdict(first: str, second: str, label: str = "GLOBAL-SPECTROGRAM") -> Column:
    """``first`` may be strong alone (promising); ``second`` strong alone is a one-set result."""
    a, b, extra = F.col(f"{first}_strong"), F.col(f"{second}_strong"), F.col("complementary")
    return (
        F.when(~F.coalesce(F.col("ok"), F.lit(False)), "INCONCLUSIVE")
        .when(a & b & extra, f"TEMPORAL+{label} SUPPORTED")
        .when(b & ~a, f"{label} SUPPORTED ONLY ON {second.upper()}")
        .when(a & ~b, f"{label} PROMISING BUT WEAKER")
        .when(~extra, f"{label} NOT COMPLEMENTARY")
        .otherwise(f"{label} NOT SUPPORTED")
    )


def complementarity_supported(
    pairs: str = "pairs", headroom: str = "mean_headroom", reached: str = "seeds_reached", ci_low: str = "lowest_ci",
    expected: int = 6, minimum_headroom: float = 0.01, minimum_seeds: int = 4, floor: float = 0.0,
) -> Column:
    return (
        (F.col(pairs) == expected)
        & (F.col(headroom) >= minimum_headroom)
        & (F.col(reached) >= minimum_seeds)
        & (F.col(ci_low) > floor)
    )


def fusion_verdict(summaries: DataFrame) -> DataFrame:
    """One verdict over datasets.

    ``summaries``: one row per dataset with adaptive_positive (seeds), static_positive
    (seeds) and adaptive_lowest_ci (the lowest per-seed interval floor).
    """
    row = summaries.agg(
        F.min("adaptive_positive").alias("adaptive_min"),
        F.max("adaptive_positive").alias("adaptive_max"),
        F.min("static_positive").alias("static_min"),
        F.min("adaptive_lowest_ci").alias("ci"),
    )
    strong = (F.col("adaptive_min") >= 4) & (F.col("ci") > 0)
    static, some = F.col("static_min") >= 4, F.col("adaptive_max") >= 3
    return row.withColumn(
        "verdict",
        F.when(strong, "ADAPTIVE FUSION CONFIRMED ACROSS DATASETS")
        .when(static & some, "ADAPTIVE FUSION PARTIALLY SUPPORTED")
        .when(static, "STATIC MULTIMODAL FUSION CONFIRMED; ADAPTIVE NOT CONFIRMED")
        .when(some, "DATASET-DEPENDENT FUSION BENEFIT")
        .otherwise("FUSION NOT CONFIRMED"),
    )


def audit_verdict(integrity_pass: Column, alignment: Column, best_mcc: Column) -> Column:
    return (
        F.when(~F.coalesce(integrity_pass, F.lit(False)), "INCONCLUSIVE")
        .when((alignment == "VALID") & is_finite(best_mcc) & (best_mcc >= 0.60), "GO")
        .otherwise("PIVOT")
    )


def conservative_study_verdict() -> Column:
    """GO / NO-GO / REVISE from best_individual_mcc, delta, ci_low, error_reduction,
    oracle_delta, recoverable and dev_delta."""
    d, floor = F.col("delta"), F.col("ci_low")
    go = F.when(F.col("best_individual_mcc") < 0.98, (d >= 0.005) & (floor > 0)).otherwise(
        (d > 0) & (floor > 0) & (F.col("error_reduction") >= 0.10)
    )
    return (
        F.when(go, "GO").when((F.col("oracle_delta") < 0.01) & (F.col("recoverable") < 0.15), "NO-GO").otherwise("REVISE")
    )


def reliability_study_verdict() -> Column:
    """From mean_delta, ci_low, positive_seeds, net_error_reduction, reliability_auc,
    adaptive_recall and fixed_recall."""
    base = (
        (F.col("ci_low") > 0)
        & (F.col("positive_seeds") >= 4)
        & (F.col("reliability_auc") > 0.55)
        & (F.col("adaptive_recall") >= F.col("fixed_recall") - 0.01)
    )
    strong = base & (F.col("mean_delta") >= 0.005) & (F.col("net_error_reduction") > 0)
    return (
        F.when(strong, "STRONG GO")
        .when(base & (F.col("mean_delta") >= 0.002), "MODERATE GO")
        .otherwise("NO-GO FOR ADAPTIVE FUSION")
    )
