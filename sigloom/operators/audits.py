"""Integrity audits and group rollups of signal metadata and sparse feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import ratio
from sigloom.operators.checks import require, require_columns
from sigloom.operators.ordering import exact_quantiles

PHASES = ("0", "1", "2")
# The eight label patterns of a three-phase group.
PATTERNS = ("000", "001", "010", "011", "100", "101", "110", "111")


def audit_metadata(df: DataFrame, group: str = "id_measurement", phase: str = "phase", target: str = "target") -> DataFrame:
    """One row of integrity counts.

    Rows fold to (group, phase), then to groups, then to totals, so a group holding a third
    of the table is a handful of rows after the first map-side combine.
    """
    per_phase = df.groupBy(group, phase).agg(
        F.count(F.lit(1)).alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi"), F.sum(target).alias("pos")
    )
    per_group = per_phase.groupBy(group).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("phases"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("pos").alias("pos"),
    )
    phases = df.select(phase).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") != 3).alias("groups_without_three_rows"),
        F.count_if(F.col("phases") != 3).alias("groups_without_three_phases"),
        F.count_if(F.col("lo") != F.col("hi")).alias("mixed_label_groups"),
        F.sum("pos").alias("positives"),
        (F.sum("n") - F.sum("pos")).alias("negatives"),
    ).withColumn("distinct_phases", phases)


def value_counts(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Counts over a fixed domain; values that do not occur get 0."""
    names = [f"v{k}" for k in range(len(domain))]
    counted = df.agg(*[F.count_if(F.col(column) == d).alias(n) for n, d in zip(names, domain)])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("value"), F.col(n).alias("count")) for n, d in zip(names, domain)]))
    return counted.select(rows.alias("r")).select("r.*")


def complete_groups(df: DataFrame, group: str = "id_measurement", phase: str = "phase") -> DataFrame:
    """Groups with exactly one row for each of the three phases."""
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(phase) == p).alias(f"n{p}") for p in PHASES])
        .where("n = 3 AND n0 = 1 AND n1 = 1 AND n2 = 1")
        .select(group)
    )


def group_patterns(df: DataFrame, group: str = "id_measurement", phase: str = "phase", target: str = "target") -> DataFrame:
    """Label pattern of every group in phase order; null where a phase is missing."""
    parts = [F.max(F.when(F.col(phase) == p, F.col(target))).cast("string") for p in PHASES]
    return df.groupBy(group).agg(F.concat(*parts).alias("pattern"))


def phase_patterns(df: DataFrame, group: str = "id_measurement") -> DataFrame:
    """Count and share of the eight patterns over all groups, zero-filled."""
    counted = group_patterns(df, group).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("pattern") == p).alias(f"p{p}") for p in PATTERNS]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{p}").alias("measurements")) for p in PATTERNS])
    )
    return counted.select("total", rows.alias("r")).select(
        "r.*", ratio("r.measurements", F.greatest(F.col("total"), F.lit(1))).alias("proportion")
    )


def group_label_summary(df: DataFrame, group: str = "id_measurement", target: str = "target") -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(target).alias("any_positive"),
        (F.sum(target) == F.count(F.lit(1))).cast("int").alias("all_positive"),
        (F.min(target) != F.max(target)).cast("int").alias("mixed"),
    )


def coalesce_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Collapse sparse rows of a key to its non-null value per column.

    Each column is filled by at most one row of the key, so ``max`` picks it
    deterministically whatever the row order.
    """
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in rest])


def to_group_level(
    df: DataFrame, features: Sequence[str], group: str = "id_measurement", target: str = "target", first_by: str = "sample_id"
) -> DataFrame:
    """Mean features, any-positive label, and the split of the group's first row."""
    return df.groupBy(group).agg(
        *[F.avg(c).alias(c) for c in features],
        F.max(target).alias(target),
        F.min_by("split", first_by).alias("split"),
    )


def three_phase_features(df: DataFrame, cols: Sequence[str], phases: Sequence[str] = PHASES, group: str = "id_measurement") -> DataFrame:
    """Attach every phase's features to each signal row; the row keeps its own target.

    The features of a group are conditional aggregates, which combine before the shuffle, so a
    malformed group of any size costs a few numbers per task; they are joined to the rows by
    group. A group without exactly one row per phase fails the query.
    """
    require_columns(df, ["sample_id", group, "phase", "target", *cols])
    if len(set(phases)) != 3:
        raise ValueError("exactly three distinct phases are required")
    of = {p: F.col("phase") == p for p in phases}
    wide = df.groupBy(F.col(group).alias("_group")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(of[p]).alias(f"_n{p}") for p in phases],
        *[F.max(F.when(of[p], F.col(c))).alias(f"phase_{p}_{c}") for c in cols for p in phases],
    )
    ok = F.col("_n") == 3
    for p in phases:
        ok = ok & (F.col(f"_n{p}") == 1)
    checked = require(wide, ok, "group does not hold exactly one row per phase")
    keep = [c for c in df.columns if c not in cols]
    joined = df.select(*keep).join(checked, F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*keep, *[f"phase_{p}_{c}" for c in cols for p in phases])


def positive_class_weight(df: DataFrame, target: str = "target", split: str = "train") -> DataFrame:
    """negatives / positives over training rows; null when a class is absent."""
    counts = df.where(F.col("split") == split).agg(
        F.count_if(F.col(target) == 0).alias("negatives"), F.count_if(F.col(target) == 1).alias("positives")
    )
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    return counts.withColumn(
        "positive_weight", F.when(both, F.col("negatives").cast("double") / F.col("positives"))
    )


def crosstab(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


ALIGNMENT_METHODS = ("current", "strict", "sinusoid")


def alignment_summary(
    records: DataFrame,
    methods: Sequence[str] = ALIGNMENT_METHODS,
    minimum_success: float = 0.95,
    maximum_degrees: float = 20.0,
) -> DataFrame:
    """Success rates, complete groups, median disagreement and the resulting status.

    ``records``: sample_id, id_measurement, ``<m>_success`` (0/1) per method and an array
    column ``disagreements`` holding the available pairwise differences in degrees.
    """
    every = F.lit(True)
    for m in methods:
        every = every & (F.col(f"{m}_success") == 1)
    rates = records.agg(
        *[F.avg(F.col(f"{m}_success").cast("double")).alias(f"{m}_rate") for m in methods],
        F.avg(every.cast("double")).alias("all_method_rate"),
    )
    groups = (
        records.groupBy("id_measurement")
        .agg(F.sum(f"{methods[0]}_success").alias("hits"))
        .agg(F.avg((F.col("hits") == 3).cast("double")).alias("r"))
    )
    median = exact_quantiles(
        records.select(F.explode("disagreements").alias("d")).where(F.col("d").isNotNull()), [], "d", {"m": 0.5}
    )
    out = rates.withColumn("complete_group_rate", groups.scalar()).withColumn("median_disagreement", median.scalar())
    high, half = F.lit(True), F.lit(True)
    for m in methods:
        high = high & (F.col(f"{m}_rate") >= minimum_success)
        half = half & (F.col(f"{m}_rate") >= 0.5)
    valid = high & (F.col("complete_group_rate") >= minimum_success) & (F.col("median_disagreement") <= maximum_degrees)
    return out.withColumn(
        "status", F.when(valid, "VALID").when(half, "PARTIAL/AMBIGUOUS").otherwise("INVALID")
    )
