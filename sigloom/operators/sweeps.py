"""Operating-point searches over small parameter grids.

Scores are counted into the cells of the threshold grid k/200 once; every threshold is then
a cumulative sum over at most 182 cells per key. Cost is one pass over the rows plus the
grid, not rows x thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.confusion import mcc, rates
from sigloom.functions.fusion import conservative, weighted
from sigloom.functions.scalars import ColumnLike, as_col, ratio, softplus

# The threshold grid 0.05 … 0.95 in steps of 0.005, as k/200.
STEPS, FIRST, LAST = 200, 10, 190
# The reliability-gap grid of the conservative rule.
DELTAS = (0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.25)
# Override thresholds 0.50 … 0.95 in steps of 0.005, as k/200.
TAU_FIRST, TAU_LAST = 100, 190


def grid_cell(probability: ColumnLike, first: int = FIRST, last: int = LAST) -> Column:
    """Largest k with probability >= k/200, clamped to [first-1, last].

    ``floor(p*200)`` may be one off next to an edge, so it is corrected with the very
    comparison a decision would make.
    """
    p = as_col(probability)
    k = F.floor(p * F.lit(float(STEPS)))

    def edge(j: Column) -> Column:
        return j.cast("double") / F.lit(float(STEPS))

    exact = F.when(p < edge(k), k - 1).when(p >= edge(k + 1), k + 1).otherwise(k)
    return F.greatest(F.least(exact, F.lit(last)), F.lit(first - 1)).cast("int")


def threshold_curve(df: DataFrame, by: Sequence[str], probability: str = "probability", target: str = "target") -> DataFrame:
    """Confusion counts and all rates at each of the 181 thresholds."""
    by = list(by)
    cells = df.groupBy(*by, grid_cell(probability).alias("cell")).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    folded = cells.groupBy(*by).agg(
        F.collect_list(F.struct("cell", "pos", "neg")).alias("h"),  # at most 182 entries
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    spread = folded.select("*", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))).alias("k"))

    def at_or_above(field: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate(
            "h", zero, lambda acc, x: acc + F.when(x["cell"] >= F.col("k"), x[field]).otherwise(zero)
        )

    counted = spread.select(*by, "k", at_or_above("pos").alias("tp"), at_or_above("neg").alias("fp"), "p", "n")
    return counted.select(
        *by,
        "k",
        (F.col("k").cast("double") / F.lit(float(STEPS))).alias("threshold"),
        (F.col("n") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("p") - F.col("tp")).alias("fn"),
        "tp",
    ).select("*", *rates())


def select_threshold(
    df: DataFrame, by: Sequence[str], probability: str = "probability", target: str = "target", tie: str = "nearest_half"
) -> DataFrame:
    """Best threshold by MCC per key.

    ``nearest_half``: all thresholds within 1e-8 + 1e-5*|best| count as tied and the one
    nearest 0.5 wins. ``first``: the lowest threshold reaching the exact maximum.
    """
    by = list(by)
    curve = threshold_curve(df, by, probability, target)
    top = F.max("mcc").over(Window.partitionBy(*by))  # 181 rows per key
    marked = curve.withColumn("_top", top)
    if tie == "nearest_half":
        ok = F.abs(F.col("mcc") - F.col("_top")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("_top")
        rank = F.struct(F.abs(F.col("k") - STEPS // 2), F.col("k"))
    elif tie == "first":
        ok = F.col("mcc") == F.col("_top")
        rank = F.struct(F.col("k"))
    else:
        raise ValueError(f"unknown tie rule {tie}")
    return (
        marked.where(ok)
        .groupBy(*by)
        .agg(F.min_by(F.struct("k", "threshold", "mcc"), rank).alias("best"))
        .select(*by, "best.*")
    )


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key of a small candidate table under a composite tie-break."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r")


def weight_curve(
    df: DataFrame, by: Sequence[str], a: str, b: str, target: str = "target", points: int = 21
) -> DataFrame:
    """For each mixture weight of ``a``: its own best threshold and MCC."""
    by = list(by)
    spread = df.select(*by, target, a, b, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("w"))
    weight = F.col("w").cast("double") / F.lit(float(points - 1))
    mixed = spread.withColumn("_mix", weighted(a, b, weight))
    best = select_threshold(mixed, [*by, "w"], "_mix", target)
    return best.withColumn("weight", weight)


def select_fixed_weight(
    df: DataFrame, by: Sequence[str], a: str, b: str, target: str = "target", points: int = 21, tie: str = "nearest_half"
) -> DataFrame:
    """Best (weight, threshold) by MCC; ties go to the weight nearest 0.5, or to the largest."""
    curve = weight_curve(df, by, a, b, target, points)
    if tie == "nearest_half":
        order = [F.desc("mcc"), F.abs(F.col("w") * 2 - (points - 1)), F.col("w")]
    else:
        order = [F.desc("mcc"), F.desc("w")]
    return best_row(curve, by, order)


def temperatures(points: int = 81, low: float = 0.25, high: float = 4.0) -> list[float]:
    step = (math.log(high) - math.log(low)) / (points - 1)
    return [math.exp(math.log(low) + step * k) for k in range(points)]


def temperature_curve(df: DataFrame, by: Sequence[str], logit: str, target: str = "target", points: int = 81) -> DataFrame:
    """Mean negative log-likelihood at each temperature of a log-spaced grid: one average for each
    temperature in a single aggregation, so rows are not multiplied."""
    steps = temperatures(points)

    def loss(t: float) -> Column:
        z = F.col(logit) / F.lit(t)
        return F.avg(softplus(z) - F.col(target) * z)

    curve = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(t).alias("temperature"), loss(t).alias("nll")) for t in steps]).alias("_c"))
    return curve.select(*by, F.posexplode("_c").alias("step", "_e")).select(*by, "step", "_e.temperature", "_e.nll")


def fit_temperature(df: DataFrame, by: Sequence[str], logit: str, target: str = "target", points: int = 81) -> DataFrame:
    curve = temperature_curve(df, by, logit, target, points)
    return best_row(curve, by, [F.col("nll"), F.col("step")])


def select_delta(
    df: DataFrame, by: Sequence[str], fixed: str, adapted: str, ra: str, rb: str, target: str = "target",
    deltas: Sequence[float] = DELTAS,
) -> DataFrame:
    """Reliability gap below which the fixed mixture is kept; ties go to the smaller gap."""
    by = list(by)
    grid = F.array(*[F.lit(float(d)) for d in deltas])
    spread = df.select(*by, target, fixed, adapted, ra, rb, F.explode(grid).alias("delta"))
    mixed = spread.withColumn("_mix", conservative(fixed, adapted, ra, rb, "delta"))
    curve = select_threshold(mixed, [*by, "delta"], "_mix", target)
    return best_row(curve, by, [F.desc("mcc"), F.col("delta")])


def override_curve(
    df: DataFrame, by: Sequence[str], target: str, anchor: str, alternative: str, score: str
) -> DataFrame:
    """Outcome of a disagreement gate at each of the 91 override thresholds."""
    by = list(by)
    differ = F.col(anchor) != F.col(alternative)
    cell = F.when(differ, grid_cell(score, TAU_FIRST, TAU_LAST)).otherwise(F.lit(TAU_FIRST - 1))
    cells = df.groupBy(
        *by, cell.alias("cell"), F.col(target).alias("y"), F.col(anchor).alias("a"), F.col(alternative).alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))
    folded = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "y", "a", "b", "n")).alias("h"))  # <= 92*8
    spread = folded.select("*", F.explode(F.sequence(F.lit(TAU_FIRST), F.lit(TAU_LAST))).alias("k"))
    zero = F.lit(0).cast("bigint")

    def total(rule) -> Column:
        return F.aggregate("h", zero, lambda acc, x: acc + F.when(rule(x), x["n"]).otherwise(zero))

    def final(x) -> Column:
        return F.when(x["cell"] >= F.col("k"), x["b"]).otherwise(x["a"])

    def fired(x) -> Column:
        return x["cell"] >= F.col("k")

    counted = spread.select(
        *by,
        "k",
        total(lambda x: (x["y"] == 0) & (final(x) == 0)).alias("tn"),
        total(lambda x: (x["y"] == 0) & (final(x) == 1)).alias("fp"),
        total(lambda x: (x["y"] == 1) & (final(x) == 0)).alias("fn"),
        total(lambda x: (x["y"] == 1) & (final(x) == 1)).alias("tp"),
        total(fired).alias("overrides"),
        total(lambda x: fired(x) & (x["a"] != x["y"])).alias("beneficial"),
        total(lambda x: fired(x) & (x["a"] == x["y"])).alias("harmful"),
    )
    return counted.select(
        *by,
        "k",
        (F.col("k").cast("double") / F.lit(float(STEPS))).alias("tau"),
        mcc().alias("mcc"),
        "overrides",
        "beneficial",
        "harmful",
        ratio("beneficial", "overrides").alias("override_precision"),
    )


def select_tau(df: DataFrame, by: Sequence[str], target: str, anchor: str, alternative: str, score: str, tie: str = "precision") -> DataFrame:
    """Best override threshold: MCC, then override precision (or low harm), then the smaller tau."""
    curve = override_curve(df, by, target, anchor, alternative, score)
    if tie == "precision":
        order = [F.desc("mcc"), F.desc("override_precision"), F.col("k")]
    else:
        order = [F.desc("mcc"), F.col("k"), F.col("harmful")]
    return best_row(curve, by, order)


def best_individual(df: DataFrame, by: Sequence[str], method: str = "method") -> DataFrame:
    """The stronger method per key at its own best threshold; ties go to the first name."""
    curve = select_threshold(df, [*by, method])
    return best_row(curve, by, [F.desc("mcc"), F.desc(method)])


def candidate_scores(
    predictions: DataFrame, by: Sequence[str] = ("seed",), oof: str = "train_oof", validation: str = "validation"
) -> DataFrame:
    """Threshold from OOF rows; MCC on OOF and validation; best and weakest expert per key."""
    by = list(by)
    keys = [*by, "method"]
    points = select_threshold(predictions.where(F.col("split") == oof), keys).select(
        *keys, F.col("threshold").alias("_cut")
    )
    scored = predictions.where(F.col("split").isin(oof, validation)).join(points, keys)
    y, d = F.col("target"), (F.col("probability") >= F.col("_cut")).cast("int")
    per = scored.groupBy(*keys, "split").agg(
        F.max("_cut").alias("threshold"),
        mcc(
            tp=F.count_if((y == 1) & (d == 1)), tn=F.count_if((y == 0) & (d == 0)),
            fp=F.count_if((y == 0) & (d == 1)), fn=F.count_if((y == 1) & (d == 0)),
        ).alias("mcc"),
    )
    wide = per.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        F.max(F.when(F.col("split") == oof, F.col("mcc"))).alias("oof_mcc"),
        F.max(F.when(F.col("split") == validation, F.col("mcc"))).alias("validation_mcc"),
    )
    return wide.withColumns(
        {
            "best_individual_mcc": F.max("validation_mcc").over(Window.partitionBy(*by)),
            "minimum_expert_mcc": F.min("validation_mcc").over(Window.partitionBy(*by)),
        }
    )
