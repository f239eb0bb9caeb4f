"""Score metrics over a long prediction table (target, probability, threshold)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.confusion import confusion_counts, decision, mcc, rates
from sigloom.functions.scalars import clip, ratio
from sigloom.operators.ordering import attach, exact_quantiles, global_rank, ordered_prefix
from sigloom.session import cut_lineage


def binary_metrics(df: DataFrame, by: Sequence[str], target: str = "target", prediction: str | None = None) -> DataFrame:
    """Confusion counts and rates per key in one partial+final aggregation."""
    hard = F.col(prediction) if prediction else decision()
    return df.groupBy(*by).agg(*confusion_counts(target, hard)).select("*", *rates())


def score_counts(df: DataFrame, by: Sequence[str], target: str = "target", probability: str = "probability") -> DataFrame:
    return df.groupBy(*by, probability).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )


def cumulative_counts(df: DataFrame, by: Sequence[str], target: str = "target", probability: str = "probability") -> DataFrame:
    """Positives and negatives strictly below each distinct score."""
    return ordered_prefix(score_counts(df, by, target, probability), by, [probability], ["pos", "neg"])


def ranking_metrics(df: DataFrame, by: Sequence[str], target: str = "target", probability: str = "probability") -> DataFrame:
    """ROC-AUC (ties count half, NaN for one class) and step-wise average precision.

    Both are sums over distinct scores, so one ordered prefix serves the two.
    """
    return ranking_of_counts(score_counts(df, by, target, probability), by, probability)


def ranking_of_counts(counts: DataFrame, by: Sequence[str], probability: str = "probability") -> DataFrame:
    """``ranking_metrics`` of positives (pos) and negatives (neg) per distinct score."""
    by = list(by)
    steps = ordered_prefix(counts, by, [probability], ["pos", "neg"])
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    steps = attach(steps, totals, by)
    tp = (F.col("_p") - F.col("pos_before")).cast("double")
    fp = (F.col("_n") - F.col("neg_before")).cast("double")
    return steps.groupBy(*by).agg(
        F.max("_p").alias("positives"),
        F.max("_n").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.lit(0.5) * F.col("neg"))).alias("_wins"),
        F.sum(F.col("pos") * ratio(tp, tp + fp)).alias("_precision_mass"),
    ).select(
        *by,
        "positives",
        "negatives",
        ratio(F.col("_wins"), F.col("positives").cast("double") * F.col("negatives"), float("nan")).alias("roc_auc"),
        ratio(F.col("_precision_mass"), F.col("positives")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "positives", "negatives", "roc_auc")


def average_precision(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return ranking_metrics(df, by).select(*by, "average_precision")


def brier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    error = F.col("probability") - F.col("target")
    return df.groupBy(*by).agg(F.avg(error * error).alias("brier"))


def log_loss(df: DataFrame, by: Sequence[str], eps: float = 1e-7) -> DataFrame:
    p = clip("probability", eps, 1.0 - eps)
    loss = -F.when(F.col("target") == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def probability_bin(bins: int, probability: str = "probability"):
    """Equal-width bin index; the last bin is closed on the right."""
    return F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")


def reliability_points(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    return (
        df.groupBy(*by, probability_bin(bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("probability").alias("mean_probability"),
            F.avg("target").alias("observed_rate"),
        )
    )


def ece(df: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
    return reliability_points(df, by, bins).groupBy(*by).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece")
    )


def reliability_deciles(
    df: DataFrame, by: Sequence[str], reliability: str, outcome: str, tie: str = "sample_id", bins: int = 10
) -> DataFrame:
    """Equal-count bins of the first-come rank, cut at the linear quantiles of 1..n."""
    by = list(by)
    ranked = global_rank(df, by, [reliability, tie])
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach(ranked, sizes, by)
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    position = F.col("rank") - 1
    decile = F.greatest(F.floor((position * bins + span - 1) / span) - 1, F.lit(0)).cast("int")
    return ranked.groupBy(*by, decile.alias("decile")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(reliability).alias("mean_reliability"),
        F.avg(outcome).alias("mean_outcome"),
    )


def probability_summary(df: DataFrame, by: Sequence[str], value: str = "probability") -> DataFrame:
    """count, min, max, mean and exact p01/p10/median/p90/p99."""
    by = list(by)
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )
    points = exact_quantiles(
        df, by, value, {"p01": 0.01, "p10": 0.10, "median": 0.5, "p90": 0.90, "p99": 0.99}
    )
    return attach(basic, points, by)


def noise_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, 1.4826 * MAD, population std and percentiles of |x - median|."""
    by = list(by)
    centre = exact_quantiles(df, by, value, {"median": 0.5})
    centred = attach(df, centre, by)
    spread = exact_quantiles(
        centred.withColumn("_dev", F.abs(F.col(value) - F.col("median"))),
        by,
        "_dev",
        {"p01_abs": 0.01, "p50_abs": 0.5, "p90_abs": 0.9, "p99_abs": 0.99},
    ).withColumn("mad_std", F.col("p50_abs") * F.lit(1.4826))
    std = df.groupBy(*by).agg(F.stddev_pop(value).alias("std"))
    return attach(attach(centre, spread, by), std, by)


def seed_by_method(metrics: DataFrame, methods: Sequence[str], base: str, metric: str = "mcc") -> DataFrame:
    """One row per seed, one column per method, and each method's delta to ``base``."""
    wide = metrics.groupBy("seed").pivot("method", list(methods)).agg(F.first(metric))
    return wide.select(
        "seed",
        *methods,
        *[(F.col(m) - F.col(base)).alias(f"{m}_minus_{base}") for m in methods if m != base],
    )


def summarize_methods(metrics: DataFrame, by: Sequence[str] = ("method",), metric: str = "mcc") -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count(metric).alias("n"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
    )


def summarize_deltas(deltas: DataFrame, by: Sequence[str], delta: str = "delta") -> DataFrame:
    """One row per comparison over its few seeds: mean, sample sd, median, sign counts."""
    return deltas.groupBy(*by).agg(
        F.count(delta).alias("n_seeds"),
        F.avg(delta).alias("mean"),
        F.coalesce(F.stddev_samp(delta), F.lit(0.0)).alias("sd"),
        F.percentile(delta, F.lit(0.5)).alias("median"),
        F.count_if(F.col(delta) > 0).alias("positive_seeds"),
        F.count_if(F.col(delta) >= 0.005).alias("target_reached_seeds"),
    )


def phase_effects(features: DataFrame, bins: Sequence[str], target: str = "target") -> DataFrame:
    """Per-class n, mean, median and p90 of every phase-bin count column."""
    long = features.unpivot([target], list(bins), "phase_bin", "value")
    basic = long.groupBy("phase_bin", target).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    points = exact_quantiles(long, ["phase_bin", target], "value", {"median": 0.5, "p90": 0.9})
    return basic.join(points, ["phase_bin", target])


# Paired decisions of two methods ------------------------------------------------------

def correctness_category(target: str, a: str, b: str):
    ok_a, ok_b = F.col(a) == F.col(target), F.col(b) == F.col(target)
    return (
        F.when(ok_a & ok_b, "both_correct").when(ok_a, "a_only").when(ok_b, "b_only").otherwise("both_wrong")
    )


def oracle_decision(target: str, a: str, b: str):
    """Non-deployable upper bound: right whenever either of the two tuned decisions is."""
    return F.when(F.col(a) == F.col(target), F.col(a)).otherwise(F.col(b))


def overlap_states(pair: DataFrame, by: Sequence[str], target: str, a: str, b: str) -> DataFrame:
    """Counts and shares of the four states for all rows and per class (grouping sets)."""
    by = list(by)
    tagged = pair.select(*by, F.col(target).alias("_y"), correctness_category(target, a, b).alias("state"))
    sets = tagged.groupingSets(
        [[*by, "state"], [*by, "_y", "state"]], *by, "_y", "state"
    ).agg(F.grouping("_y").alias("_all"), F.count(F.lit(1)).alias("_count"))
    stratum = F.when(F.col("_all") == 1, "all").when(F.col("_y") == 1, "PD").otherwise("NonPD")
    wide = sets.groupBy(*by, stratum.alias("stratum")).agg(
        *[
            F.sum(F.when(F.col("state") == s, F.col("_count")).otherwise(0)).alias(s)
            for s in ("both_correct", "a_only", "b_only", "both_wrong")
        ],
        F.sum("_count").alias("_n"),
    )
    return wide.unpivot(
        [*by, "stratum", "_n"], ["both_correct", "a_only", "b_only", "both_wrong"], "state", "count"
    ).select(*by, "stratum", "state", "count", ratio("count", "_n").alias("fraction"))


def joint_states(pair: DataFrame, by: Sequence[str], target: str, a: str, b: str) -> DataFrame:
    """Rows per joint (target, a, b) state: s0..s7 with state = 4*target + 2*a + b."""
    state = F.col(target) * 4 + F.col(a) * 2 + F.col(b)
    return pair.groupBy(*by).agg(*[F.count_if(state == k).alias(f"s{k}") for k in range(8)])


def mcc_of_states(which: str, prefix: str = "s"):
    """MCC of decision a or b from the eight joint-state counts."""
    s = [F.col(f"{prefix}{k}").cast("double") for k in range(8)]
    if which == "a":
        return mcc(tp=s[6] + s[7], tn=s[0] + s[1], fp=s[2] + s[3], fn=s[4] + s[5])
    if which == "b":
        return mcc(tp=s[5] + s[7], tn=s[0] + s[2], fp=s[1] + s[3], fn=s[4] + s[6])
    return mcc(tp=s[5] + s[6] + s[7], tn=s[0] + s[1] + s[2], fp=s[3], fn=s[4])  # oracle


def overlap_oracle(pair: DataFrame, by: Sequence[str], target: str, a: str, b: str) -> DataFrame:
    """Disagreement rate, individual and oracle MCC, and the oracle's headroom."""
    states = joint_states(pair, by, target, a, b)
    n = sum((F.col(f"s{k}") for k in range(1, 8)), F.col("s0"))
    differ = F.col("s1") + F.col("s2") + F.col("s5") + F.col("s6")
    out = states.select(
        *by,
        ratio(differ, n).alias("disagreement_rate"),
        mcc_of_states("a").alias("a_mcc"),
        mcc_of_states("b").alias("b_mcc"),
        mcc_of_states("oracle").alias("oracle_mcc"),
    )
    stronger = F.greatest("a_mcc", "b_mcc")
    return out.select("*", stronger.alias("stronger_mcc"), (F.col("oracle_mcc") - stronger).alias("oracle_headroom"))


def complementarity(pair: DataFrame, by: Sequence[str], target: str, pa: str, pb: str, a: str, b: str) -> DataFrame:
    """Pearson of the two probabilities (undefined -> 0), disagreement and exclusive hits."""
    ok_a, ok_b = F.col(a) == F.col(target), F.col(b) == F.col(target)
    corr = F.corr(pa, pb)
    return pair.groupBy(*by).agg(
        F.when(corr.isNull() | F.isnan(corr), 0.0).otherwise(corr).alias("probability_correlation"),
        F.avg((F.col(a) != F.col(b)).cast("double")).alias("disagreement_rate"),
        F.count_if(ok_a & ~ok_b).alias("a_exclusive_correct"),
        F.count_if(~ok_a & ok_b).alias("b_exclusive_correct"),
    )


def error_transitions(pair: DataFrame, by: Sequence[str], target: str, before: str, after: str) -> DataFrame:
    was_wrong, is_wrong = F.col(before) != F.col(target), F.col(after) != F.col(target)
    return pair.groupBy(*by).agg(
        F.count_if(was_wrong & ~is_wrong).alias("corrected"),
        F.count_if(~was_wrong & is_wrong).alias("introduced"),
        F.count_if(was_wrong == is_wrong).alias("unchanged"),
    ).withColumn("net", F.col("corrected") - F.col("introduced"))


def override_stats(pair: DataFrame, by: Sequence[str], target: str, anchor: str, final: str) -> DataFrame:
    """How often replacing the anchor's decision helped, and the share of its errors recovered."""
    changed = F.col(anchor) != F.col(final)
    anchor_wrong = F.col(anchor) != F.col(target)
    return pair.groupBy(*by).agg(
        F.count_if(changed).alias("overrides"),
        F.count_if(changed & anchor_wrong).alias("beneficial"),
        F.count_if(changed & ~anchor_wrong).alias("harmful"),
        F.count_if(anchor_wrong).alias("anchor_errors"),
    ).select(
        "*",
        ratio("beneficial", "overrides").alias("override_precision"),
        (F.col("beneficial") - F.col("harmful")).alias("net"),
        ratio("beneficial", "anchor_errors").alias("recovered_fraction"),
    )


def shift_summary(pair: DataFrame, by: Sequence[str], target: str, a: str, b: str, reliability: str) -> DataFrame:
    """Correctness given disagreement, and the spread of a reliability score."""
    differ = F.col(a) != F.col(b)
    ok_a, ok_b = (F.col(a) == F.col(target)).cast("double"), (F.col(b) == F.col(target)).cast("double")
    basic = pair.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(differ.cast("double")).alias("disagreement_rate"),
        F.coalesce(F.avg(F.when(differ, ok_a)), F.lit(0.0)).alias("a_correct_given_disagreement"),
        F.coalesce(F.avg(F.when(differ, ok_b)), F.lit(0.0)).alias("b_correct_given_disagreement"),
        F.avg(reliability).alias("reliability_mean"),
    )
    points = exact_quantiles(pair, by, reliability, {"reliability_p10": 0.1, "reliability_p90": 0.9})
    return basic.join(points, list(by))


def _stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's formula, for whole n >= 1: summed exactly up to 15, a series beyond."""
    exact = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + 0.5 * math.log(2 * math.pi)) for k in range(1, 16)]
    x = n.cast("double")
    square = x * x
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / square) / square) / square) / x
    return F.when(n <= 15, F.element_at(F.array(*[F.lit(v) for v in exact]), F.greatest(n, F.lit(1)).cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x without cancellation, as a series in (x - mean) / (x + mean)."""
    v = (x - mean) / (x + mean)
    series = F.lit(0.0)
    for j in range(15, 0, -1):
        series = (series + F.lit(1 / (2 * j + 1))) * v * v
    near = (x - mean) * v + F.lit(2.0) * x * v * series
    return F.when(F.abs(v) < 0.1, near).otherwise(x * F.ln(x / mean) + mean - x)


def half_binomial(n: Column, k: Column) -> Column:
    """Probability of k successes in n fair trials, to full precision at any n."""
    x, y, mean = k.cast("double"), (n - k).cast("double"), n.cast("double") / 2
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
    inner = F.exp(rest - _deviance(x, mean) - _deviance(y, mean)) * F.sqrt(n.cast("double") / (F.lit(2 * math.pi) * x * y))
    return F.when((k == 0) | (k == n), F.pow(F.lit(0.5), n)).otherwise(inner)


def mcnemar(pair: DataFrame, by: Sequence[str], target: str, a: str, b: str) -> DataFrame:
    """Discordant counts, exact two-sided binomial p and continuity-corrected chi-square.

    The tail is summed from min(b, c) downward by the ratio of neighbouring terms. Below
    9 * sqrt(n) + 60 terms from there, none adds to a double, so that the work per key grows
    with the root of its discordant pairs.
    """
    ok_a, ok_b = F.col(a) == F.col(target), F.col(b) == F.col(target)
    counts = pair.groupBy(*by).agg(
        F.count_if(~ok_a & ok_b).alias("a_wrong_b_correct"), F.count_if(ok_a & ~ok_b).alias("a_correct_b_wrong")
    )
    n = F.col("a_wrong_b_correct") + F.col("a_correct_b_wrong")
    low = F.least("a_wrong_b_correct", "a_correct_b_wrong")
    gap = F.abs(F.col("a_wrong_b_correct") - F.col("a_correct_b_wrong"))
    chi2 = ratio((gap - 1) * (gap - 1), n)
    counts = counts.withColumn("_n", n).withColumn("_low", low)
    first = half_binomial(F.col("_n"), F.col("_low"))
    terms = F.least(F.col("_low"), F.ceil(F.sqrt(F.col("_n").cast("double")) * 9 + 60))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), terms),
        F.struct(first.alias("term"), F.lit(0.0).alias("tail")),
        lambda acc, i: F.struct(
            (acc["term"] * (F.col("_low") - i) / (F.col("_n") - F.col("_low") + i + 1)).alias("term"),
            (acc["tail"] + acc["term"]).alias("tail"),
        ),
        lambda acc: acc["tail"],
    )
    exact = F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))
    return counts.select(*by, "a_wrong_b_correct", "a_correct_b_wrong", chi2.alias("chi_square"), exact.alias("p_value"))


def evaluate_methods(predictions: DataFrame, by: Sequence[str] = ("dataset", "seed", "split", "method")) -> DataFrame:
    """Every metric for every (dataset, seed, split, method).

    One pass over the rows folds them to distinct (key, score, threshold) cells, which are
    stored; hard metrics, Brier, calibration and ranking all come from those cells.
    """
    by = list(by)
    cells = cut_lineage(
        predictions.groupBy(*by, "probability", "threshold").agg(
            F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg")
        )
    )
    p, up = F.col("probability"), F.col("probability") >= F.col("threshold")
    per_bin = cells.groupBy(*by, probability_bin(10).alias("_bin")).agg(
        F.sum(F.when(~up, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(up, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~up, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p).alias("_sq"),
        F.sum((F.col("pos") + F.col("neg")) * p).alias("_psum"),
        F.sum("pos").alias("_ysum"),
        F.sum(F.col("pos") + F.col("neg")).alias("_n"),
        F.max("threshold").alias("threshold"),
    )
    flat = per_bin.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")],
        F.max("threshold").alias("threshold"),
        (F.sum("_sq") / F.sum("_n")).alias("brier"),
        (F.sum(F.abs(F.col("_psum") - F.col("_ysum"))) / F.sum("_n")).alias("ece"),
    ).select("*", *rates())
    scores = cells.groupBy(*by, "probability").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return flat.join(ranking_of_counts(scores, by).drop("positives", "negatives"), by)
