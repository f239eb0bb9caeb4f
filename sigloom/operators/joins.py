"""Validated joins and key-set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.checks import require, require_columns, unique_rows


def join_one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that fails at run time when either side repeats a key."""
    return unique_rows(left, on, "left key repeats").join(unique_rows(right, on, "right key repeats"), list(on), how)


def join_many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Left rows keep their count; a repeated right key fails the query.

    The right side is folded per key first. Whether it is then broadcast is left to the
    adaptive planner, which sees its measured size.
    """
    return left.join(unique_rows(right, on, "right key repeats"), list(on), how)


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows for the requested keys; a key without a row fails the query."""
    found = keys.select(*on).join(df.withColumn("_hit", F.lit(1)), list(on), "left")
    return require(found, F.col("_hit").isNotNull(), "requested key is missing").drop("_hit")


def pair_experts(
    pred: DataFrame,
    a: str,
    b: str,
    keys: Sequence[str] = ("dataset", "seed", "split", "sample_id"),
    carry: Sequence[str] = ("id_measurement", "phase", "target"),
) -> DataFrame:
    """Two method rows -> one row per sample, by one keyed aggregation (no self-join).

    Fails when a sample lacks one method, has it twice, or carries two labels.
    """
    require_columns(pred, [*keys, *carry, "method", "probability", "threshold"])
    rows = pred.where(F.col("method").isin(a, b))

    def of(method: str, col: str):
        return F.max(F.when(F.col("method") == method, F.col(col)))

    # Carried columns depend on the sample, so they join the grouping key: the aggregation
    # stays hash-based, and a sample with two labels shows up as two half-filled groups.
    wide = rows.groupBy(*keys, *carry).agg(
        *[F.count_if(F.col("method") == m).alias(f"_n_{m}") for m in (a, b)],
        *[of(m, "probability").alias(f"probability_{m}") for m in (a, b)],
        *[of(m, "threshold").alias(f"threshold_{m}") for m in (a, b)],
    )
    ok = (F.col(f"_n_{a}") == 1) & (F.col(f"_n_{b}") == 1)
    return require(wide, ok, "sample does not have exactly one row per method and one label").drop(f"_n_{a}", f"_n_{b}")


def keep_groups(df: DataFrame, groups: DataFrame, on: Sequence[str] = ("id_measurement",)) -> DataFrame:
    return df.join(groups.select(*on).distinct(), list(on), "left_semi")


def key_comparison(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: keys on one side only, and keys repeated on a side. One shuffle, folded map-side."""
    tagged = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = tagged.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
        F.count_if(F.col("l") > 1).alias("repeated_left"),
        F.count_if(F.col("r") > 1).alias("repeated_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched"),
    )


def assert_same_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    from sigloom.operators.checks import ContractError

    got = key_comparison(left, right, on).first().asDict()
    problems = {k: v for k, v in got.items() if k != "matched" and v}
    if problems:
        raise ContractError(f"key sets differ: {problems}")


def group_overlap(manifest: DataFrame, group: str = "id_measurement", split: str = "split") -> DataFrame:
    """Groups that appear in more than one split, with the (few) split names."""
    return (
        manifest.groupBy(group)
        .agg(F.array_sort(F.collect_set(split)).alias("_splits"))
        .where(F.size("_splits") > 1)
        .select(group, F.array_join("_splits", ",").alias("splits"))
    )


def pairwise(df: DataFrame, key: Sequence[str], item: str, items: Sequence[str], value: str) -> DataFrame:
    """Unordered pairs of a fixed, short list of items per key: (left_item, right_item, values).

    The items become columns and the pairs are picked from them, so each key is shuffled
    once as a single row; no self-join.
    """
    wide = df.groupBy(*key).pivot(item, list(items)).agg(F.max(value))
    pairs = [
        F.struct(
            F.lit(x).alias("left_item"), F.lit(y).alias("right_item"),
            F.col(x).alias("left_value"), F.col(y).alias("right_value"),
        )
        for x, y in combinations(sorted(items), 2)
    ]
    return (
        wide.select(*key, F.explode(F.array(*pairs)).alias("p"))
        .select(*key, "p.*")
        .where("left_value IS NOT NULL AND right_value IS NOT NULL")
    )


def nearest_bins(count: int, available: int) -> list[int]:
    """Evenly spread bin indices over 0..available-1 (round half to even, distinct)."""
    if count == available:
        return list(range(available))
    step = (available - 1) / (count - 1) if count > 1 else 0.0
    return sorted({round(k * step) for k in range(count)})


def regression_check(metrics: DataFrame, expected: DataFrame, on: Sequence[str], tolerance: float = 1e-9, value: str = "mcc") -> DataFrame:
    """Each expected value beside the measured one; missing or out of tolerance -> FAIL."""
    wanted = expected.select(*on, F.col(value).alias("expected"))
    got = metrics.select(*on, F.col(value).alias("measured"))
    ok = F.coalesce(F.abs(F.col("measured") - F.col("expected")) <= F.lit(tolerance), F.lit(False))
    return wanted.join(got, list(on), "left").withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))
