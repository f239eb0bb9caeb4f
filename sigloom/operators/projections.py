"""Row filters, column choices and value clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.confusion import decision
from sigloom.functions.scalars import finite_or, is_finite
from sigloom.operators.checks import ContractError, assert_empty, require, require_columns
from sigloom.operators.ordering import exact_quantiles

# Split names that mark held-out rows.
HOLDOUT_SPLITS = ("test", "test_confirmatory", "test_grouped_holdout", "official_unlabeled_test")


def development_only(df: DataFrame, allowed: Sequence[str] = ("train", "validation")) -> DataFrame:
    return df.where(F.col("split").isin(*allowed))


def holdout_rows(
    df: DataFrame,
    blocked_splits: Sequence[str] = HOLDOUT_SPLITS,
    blocked_pairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    hit = F.col("split").isin(*blocked_splits)
    for dataset, split in blocked_pairs:
        hit = hit | ((F.col("dataset") == dataset) & (F.col("split") == split))
    return df.where(hit)


def assert_no_holdout(df: DataFrame, **blocked) -> DataFrame:
    assert_empty(holdout_rows(df, **blocked), "held-out rows are not allowed here")
    return df


def decide(df: DataFrame, name: str = "prediction") -> DataFrame:
    """Inclusive hard decision: probability >= threshold."""
    return df.withColumn(name, decision())


def repair_predictions(df: DataFrame) -> DataFrame:
    """Fill only the missing decisions; existing ones stay as stored."""
    return df.withColumn("prediction", F.coalesce(F.col("prediction"), decision()))


def replace_rows(base: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """``base`` without the keys present in ``new``, plus all of ``new``."""
    kept = base.join(new.select(*on).distinct(), list(on), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def finite(df: DataFrame, cols: Sequence[str], mode: str = "zero", fit: DataFrame | None = None) -> DataFrame:
    """Clean non-finite values.

    ``zero``: NaN/null -> 0, +-inf -> +-1e6. ``median``: every non-finite value becomes the
    column's median over the finite rows of ``fit`` (0 for a column with none).
    """
    if mode == "zero":
        fill = {c: finite_or(c, F.lit(0.0), F.lit(1e6), F.lit(-1e6)) for c in cols}
    elif mode == "median":
        centre = column_medians(fit if fit is not None else df, cols)
        fill = {c: F.when(is_finite(c), F.col(c).cast("double")).otherwise(F.lit(centre[c])) for c in cols}
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.withColumns(fill)


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the finite values; the driver receives one number per column."""
    nan = F.lit(None).cast("double")
    long = df.select(*[finite_or(c, nan, nan, nan).alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    rows = exact_quantiles(long, ["column"], "value", {"median": 0.5}).collect()
    found = {r["column"]: r["median"] for r in rows}
    return {c: found.get(c, 0.0) for c in cols}


def column_medians_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    centre = column_medians(df, cols)
    return df.sparkSession.createDataFrame(list(centre.items()), "column string, median double")


# Column families ----------------------------------------------------------------------

# Detector feature suffixes and transform summary names, in canonical order.
LEADING_SUFFIXES = ("candidate_count", "selected_count", "noise_mad", "boundary_fraction")
STRENGTH_SUFFIXES = (
    "score_median", "score_p90", "score_max", "snr_p90", "positive_fraction",
    "spacing_median", "spacing_p10", "width_median",
)
CWT_COUNT = "cwt_event_count"
CWT_SUMMARIES = (
    "cwt_energy_low", "cwt_energy_mid", "cwt_energy_high", "cwt_log_power_mean",
    "cwt_log_power_std", "cwt_entropy", "cwt_temporal_concentration", "cwt_scale_of_max",
)
DETECTORS = ("current", "strict", "highpass", "polynomial")
FEATURE_SETS = {"S": "S", "S+T": "ST", "S+C": "SC", "S+T+C": "STC"}


def location_suffixes(quadrants: int = 4, bins: int = 20) -> tuple[str, ...]:
    return tuple(f"quadrant_{k:02d}_count" for k in range(quadrants)) + tuple(
        f"phase_bin_{k:02d}_count" for k in range(bins)
    )


def detector_columns(detector: str) -> list[str]:
    names = LEADING_SUFFIXES + STRENGTH_SUFFIXES + location_suffixes()
    return [f"{detector}_{name}" for name in names]


def canonical_features(detectors: Sequence[str] = DETECTORS) -> list[str]:
    return [c for d in detectors for c in detector_columns(d)] + [CWT_COUNT, *CWT_SUMMARIES]


def family_of(column: str, detectors: Sequence[str] = DETECTORS) -> str:
    """S structural, T temporal strength, C transform summary; anything else is an error."""
    if column == CWT_COUNT:
        return "S"
    if column in CWT_SUMMARIES:
        return "C"
    owners = [d for d in detectors if column.startswith(f"{d}_")]
    if len(owners) == 1:
        suffix = column.removeprefix(f"{owners[0]}_")
        if suffix in LEADING_SUFFIXES or suffix in location_suffixes():
            return "S"
        if suffix in STRENGTH_SUFFIXES:
            return "T"
    raise ContractError(f"column {column!r} belongs to no feature family")


def feature_inventory(cols: Sequence[str], detectors: Sequence[str] = DETECTORS) -> list[tuple[int, str, str]]:
    if len(set(cols)) != len(cols):
        raise ContractError("feature columns repeat")
    return [(k, c, family_of(c, detectors)) for k, c in enumerate(cols)]


def feature_set(inventory: Iterable[tuple[int, str, str]], name: str) -> list[str]:
    if name not in FEATURE_SETS:
        raise ContractError(f"unknown feature set {name!r}")
    return [c for _, c, family in sorted(inventory) if family in FEATURE_SETS[name]]


# --------------------------------------------------------------------------------------

def probability_violations(df: DataFrame, probability: str = "probability", target: str = "target") -> DataFrame:
    """One row: rows whose probability is not a finite value in [0,1] or target not 0/1."""
    p, y = F.col(probability), F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~is_finite(probability)).alias("non_finite"),
        F.count_if(is_finite(probability) & ~p.between(0.0, 1.0)).alias("out_of_range"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_target"),
    )


def check_probabilities(df: DataFrame, probability: str = "probability", target: str = "target") -> DataFrame:
    ok = is_finite(probability) & F.col(probability).between(0.0, 1.0) & F.coalesce(
        F.col(target).isin(0, 1), F.lit(False)
    )
    return require(df, ok, "probability must be finite in [0,1] and target 0 or 1")


def structural_zero(df: DataFrame, cols: Sequence[str], flag: str = "structural_missing") -> DataFrame:
    """A detector block that is wholly missing becomes zeros and is flagged."""
    missing = F.lit(True)
    for c in cols:
        missing = missing & (F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    flagged = df.withColumn(flag, missing.cast("int"))
    return flagged.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols})


def context_rows(
    df: DataFrame,
    cols: Sequence[str] = ("seed", "method", "expert", "mcc", "threshold"),
    split: str = "validation",
) -> DataFrame:
    """Rows of one split (any letter case), only the listed columns that exist."""
    if "split" in df.columns:
        df = df.where(F.lower(F.col("split")) == split.lower())
    return df.select(*[c for c in cols if c in df.columns])


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def by_prefix(df: DataFrame, prefix: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


def slice_exact(df: DataFrame, where: Column, n: int, key: str = "sample_id") -> DataFrame:
    """The matching rows, checked to be exactly ``n`` with unique keys."""
    part = df.where(where)
    got = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
    if got["n"] != n or got["d"] != n:
        raise ContractError(f"expected {n} unique rows, found {got['n']} rows and {got['d']} keys")
    return part


def union_results(*frames: DataFrame) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def common_values(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    return left.select(*cols).intersect(right.select(*cols))


def missing_values(expected: DataFrame, actual: DataFrame, cols: Sequence[str]) -> DataFrame:
    return expected.select(*cols).subtract(actual.select(*cols))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column names, types and nullability from metadata only; no data is read."""
    rows = [(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(df.schema.fields)]
    schema = T.StructType(
        [
            T.StructField("position", T.IntegerType()),
            T.StructField("column", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("nullable", T.BooleanType()),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)


def profile_schema(df: DataFrame) -> DataFrame:
    """Columns per type, with the table's row count (one count, no columns read)."""
    total = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return (
        schema_profile(df)
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("nullable")).alias("nullable_columns"))
        .withColumn("rows", total)
    )
