"""Fixed-length signals as array rows: windows, moments, features, embeddings.

A signal stays inside its row, so these operators are narrow: no shuffle, and memory per
task is one Arrow or row batch of signals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import kernels
from sigloom.functions.batches import signal_udf
from sigloom.functions.arrays import array_mean, array_sum, central_moments
from sigloom.functions.scalars import finite_or, ratio
from sigloom.operators.checks import assert_empty
from sigloom.operators.joins import group_overlap
from sigloom.session import cut_lineage


@dataclass(frozen=True)
class WindowSpec:
    """End-aligned windows covering a whole signal without padding."""

    length: int
    stride: int
    top_fraction: float = 0.10

    def __post_init__(self) -> None:
        if self.length < 2 or not 1 <= self.stride <= self.length:
            raise ValueError("need length >= 2 and 1 <= stride <= length")
        if not 0.0 < self.top_fraction <= 1.0:
            raise ValueError("top_fraction must be in (0, 1]")

    def starts(self, n: int) -> list[int]:
        if n < self.length:
            raise ValueError(f"signal of {n} samples is shorter than a window of {self.length}")
        last = n - self.length
        return sorted({*range(0, last + 1, self.stride), last})

    def duration(self, rate_hz: float) -> float:
        return self.length / rate_hz


def windows(df: DataFrame, spec: WindowSpec, values: str = "values") -> DataFrame:
    """One row per window: window_index, start and its slice."""
    last = F.size(values) - spec.length
    starts = F.when(
        last >= 0, F.array_distinct(F.array_append(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(spec.stride)), last))
    ).otherwise(F.raise_error(F.lit("signal is shorter than a window")).cast("array<int>"))
    keep = [c for c in df.columns if c != values]
    return df.select(*keep, values, F.posexplode(starts).alias("window_index", "start")).select(
        *keep, "window_index", "start", F.slice(values, F.col("start") + 1, F.lit(spec.length)).alias(values)
    )


def window_map(manifest: DataFrame, n: int, group: str = "id_measurement") -> DataFrame:
    """Parent -> window rows; a parent or group lying in two splits is an error."""
    assert_empty(group_overlap(manifest, "sample_id"), "sample in several splits")
    assert_empty(group_overlap(manifest, group), "group in several splits")
    return manifest.select(
        F.col("sample_id").alias("parent_id"), group, "split", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window_index")
    )


def window_score_summary(
    scores: DataFrame, fraction: float = 0.10, key: Sequence[str] = ("sample_id",), probability: str = "probability", order: str = "window_index"
) -> DataFrame:
    """Label-free summary of a signal's window scores, including the top-k mean.

    k = max(1, ceil(fraction * windows)). The ranking window and the aggregation share one
    shuffle on the signal key.
    """
    p = F.col(probability)
    w = Window.partitionBy(*key)
    ranked = scores.withColumn("_r", F.row_number().over(w.orderBy(F.desc(probability), F.col(order)))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    k = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_n")))
    first = F.max(F.when(F.col("_r") == 1, p))
    second = F.max(F.when(F.col("_r") == 2, p))
    return ranked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.max(p).alias("max_probability"),
        F.avg(p).alias("mean_probability"),
        F.avg(F.when(F.col("_r") <= k, p)).alias("top_k_mean_probability"),
        F.stddev_pop(p).alias("std_probability"),
        F.avg((p >= 0.5).cast("double")).alias("fraction_high_confidence"),
        (first - F.coalesce(second, first)).alias("top1_top2_gap"),
    )


def half_top_k(scores: DataFrame, capacity: int, fraction: float = 0.10, probability: str = "probability") -> DataFrame:
    """Event scores (sample_id, half, rank) -> one score: top-k mean per half, then their mean.

    k comes from the capacity, the divisor is min(events present, k). A sample without
    events in a half fails the query.
    """
    k = max(1, math.ceil(capacity * fraction))
    w = Window.partitionBy("sample_id", "half").orderBy(F.desc(probability), F.col("rank"))
    per_half = (
        scores.withColumn("_r", F.row_number().over(w))
        .groupBy("sample_id", "half")
        .agg(F.avg(F.when(F.col("_r") <= k, F.col(probability))).alias("_m"))
    )
    both = per_half.groupBy("sample_id").agg(F.avg("_m").alias(probability), F.count(F.lit(1)).alias("_halves"))
    bad = F.raise_error(F.lit("a half-cycle has no events")).cast("boolean")
    return both.where(F.when(F.col("_halves") == 2, F.lit(True)).otherwise(bad)).drop("_halves")


def energy_concentration(values: str | Column, fraction: float = 0.10) -> Column:
    """Share of total energy in the strongest ``fraction`` of frames (at least one)."""
    a = F.col(values) if isinstance(values, str) else values
    k = F.greatest(F.lit(1), F.floor(F.size(a) * F.lit(fraction)).cast("int"))
    return ratio(array_sum(F.slice(F.sort_array(a, asc=False), F.lit(1), k)), F.greatest(array_sum(a), F.lit(1e-12)))


# Moments ------------------------------------------------------------------------------


def _std_floor(column: str, floor: float = 1e-6) -> Column:
    sd = F.stddev_pop(column)
    return F.when(sd < floor, F.lit(1.0)).otherwise(sd)


def position_moments(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and population std per position key; a std below 1e-6 becomes 1."""
    return long.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), _std_floor(value).alias("std")
    )


def _folded_moments(per_position: bool):
    """Arrow batches of arrays -> n, mean and sum of squared deviations, per position or in all."""

    def fold(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
        axis = 0 if per_position else None
        n = ok.sum(axis=axis)
        mean = np.where(ok, x, 0.0).sum(axis=axis) / np.maximum(n, 1)
        return np.array([n, mean, (np.where(ok, x - mean, 0.0) ** 2).sum(axis=axis)], float).reshape(3, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            arrays = batch.column(0).drop_null()
            flat = arrays.flatten()
            ok = ~flat.is_null().to_numpy(zero_copy_only=False)
            x = flat.to_numpy(zero_copy_only=False).astype(float)
            lengths = arrays.value_lengths().to_numpy()
            begins = np.cumsum(lengths) - lengths
            for length in np.unique(lengths[lengths > 0]).tolist():
                at = begins[lengths == length][:, None] + np.arange(length)
                new, key = fold(x[at], ok[at]), length if per_position else 0
                old = held.get(key, np.zeros_like(new))
                n = old[0] + new[0]
                shift = new[1] - old[1]
                share = new[0] / np.maximum(n, 1)
                held[key] = np.array([n, old[1] + shift * share, old[2] + new[2] + shift**2 * old[0] * share])
        for sums in held.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(sums.shape[1], dtype=np.int32)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                ["pos", "n", "mean", "m2"],
            )

    return run


def _merged_moments(df: DataFrame, values: str, per_position: bool, variance_floor: float = 0.0) -> DataFrame:
    """pos, n, mean and variance: every task hands on one row for each position."""
    parts = df.select(F.col(values).cast("array<double>").alias("_v")).mapInArrow(
        _folded_moments(per_position), "pos int, n bigint, mean double, m2 double"
    )
    parts = cut_lineage(parts)
    count = F.sum("n")
    totals = parts.groupBy("pos").agg(count.alias("_n"), F.when(count > 0, F.sum(F.col("n") * F.col("mean")) / count).alias("_mean"))
    # Squared distances from the common mean, not differences of squares: close values far from
    # zero keep their digits.
    apart = F.col("mean") - F.col("_mean")
    sums = parts.join(totals, "pos").groupBy("pos", F.col("_n").alias("n"), F.col("_mean").alias("mean")).agg(
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("_q")
    )
    spread = F.when(F.col("n") > 0, F.greatest(F.col("_q") / F.col("n"), F.lit(variance_floor)))
    return sums.select("pos", "n", "mean", spread.alias("variance"))


def fit_standardizer(df: DataFrame, values: str = "values") -> DataFrame:
    """n, mean and population std per array position; a std below 1e-6 becomes 1. Absent (null)
    entries do not count. Tasks fold whole arrays, so no row per sample is made."""
    sd = F.sqrt("variance")
    return _merged_moments(df, values, True).select("pos", "n", "mean", F.when(sd < 1e-6, F.lit(1.0)).otherwise(sd).alias("std"))


def fit_scalar_standardizer(df: DataFrame, values: str = "values", variance_floor: float = 1e-12) -> DataFrame:
    """One mean and std over every value present; the variance is floored."""
    merged = _merged_moments(df, values, False, variance_floor).agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"), F.max("mean").alias("mean"), F.sqrt(F.max("variance")).alias("std")
    )
    return merged


def moments_array(moments: DataFrame, field: str) -> Column:
    """The moments as one array literal in position order (its size is the signal length)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", field)))
    return moments.agg(F.transform(ordered, lambda s: s[field]).alias("a")).scalar()


def standardize(df: DataFrame, moments: DataFrame, values: str = "values") -> DataFrame:
    """(x - mean) / std per position; absent (null) entries become 0."""
    fitted = df.withColumns({"_mean": moments_array(moments, "mean"), "_std": moments_array(moments, "std")})
    centred = F.zip_with(values, "_mean", lambda x, m: x - m)
    scaled = F.zip_with(centred, "_std", lambda x, s: F.coalesce(x / s, F.lit(0.0)))
    return fitted.withColumn(values, scaled).drop("_mean", "_std")


# Features -----------------------------------------------------------------------------


FEATURES = (
    "rms", "peak_abs", "energy", "std", "skewness", "kurtosis", "crest_factor",
    "spectral_centroid", "spectral_entropy", "high_frequency_ratio",
)


def signal_features(df: DataFrame, values: str = "values") -> DataFrame:
    """Seven time-domain and three spectral descriptors, all finite, from one kernel call a signal."""

    @signal_udf(", ".join(f"{n} double" for n in FEATURES))
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(all="ignore"):
            for v in series:
                x = np.asarray(v, float)
                m2, m3, m4 = kernels.central_powers(x)
                energy, peak, std = float(np.mean(x * x)), float(np.abs(x).max()), np.sqrt(m2) + 1e-8
                rms = np.sqrt(energy)
                rows.append((rms, peak, energy, std, m3 / std**3, m4 / std**4 - 3.0, peak / (rms + 1e-8), *kernels.spectral_shape(x)))
        return pd.DataFrame(rows, columns=list(FEATURES))

    keep = [c for c in df.columns if c != values]
    found = df.select(*keep, run(values).alias("_f"))
    clean = [finite_or(F.col(f"_f.{n}"), F.lit(0.0), F.lit(1e6), F.lit(-1e6)).alias(n) for n in FEATURES]
    return found.select(*keep, *clean)


def spectral_shape(values: str | Column) -> Column:
    """Power centroid, normalised entropy and share above a quarter of the band."""

    @signal_udf("centroid double, entropy double, high_ratio double")
    def run(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.spectral_shape(np.asarray(v, float)) for v in series], columns=["centroid", "entropy", "high_ratio"])

    return run(values)


QUALITY = ("rms", "peak", "peak_to_peak", "crest", "energy", "std", "kurtosis", "skewness", "robust_noise")


def signal_quality(df: DataFrame, values: str = "values") -> DataFrame:
    """rms, peak, peak-to-peak, crest, energy, std, unbiased kurtosis and skewness, and the
    robust noise of first differences, from one kernel call a signal. Values that are not defined (of
    short or constant signals) are null."""

    @signal_udf(", ".join(f"{n} double" for n in QUALITY))
    def run(series: pd.Series) -> pd.DataFrame:
        rows = []
        with np.errstate(all="ignore"):
            for v in series:
                x = np.asarray(v, float)
                k, (m2, m3, m4) = float(len(x)), map(np.float64, kernels.central_powers(x))
                rms, peak = np.sqrt(np.mean(x * x) + 1e-12), np.abs(x).max()
                kurtosis = (k - 1) / (np.float64(k - 2) * (k - 3)) * ((k + 1) * (m4 / (m2 * m2) - 3.0) + 6.0)
                skewness = np.sqrt(k * (k - 1)) / np.float64(k - 2) * (m3 / m2**1.5)
                noise = kernels.mad(np.diff(x)) / np.sqrt(2.0)
                rows.append((rms, peak, x.max() - x.min(), peak / max(rms, 1e-8), (x * x).sum(), np.sqrt(m2), kurtosis, skewness, noise))
        frame = pd.DataFrame(rows, columns=list(QUALITY))
        return frame.replace([np.inf, -np.inf], np.nan)

    keep = [c for c in df.columns if c != values]
    found = df.select(*keep, run(values).alias("_q"))
    return found.select(*keep, *[F.nanvl(F.col(f"_q.{n}"), F.lit(None).cast("double")).alias(n) for n in QUALITY])


def block_embedding(df: DataFrame, blocks: int = 20, values: str = "values", name: str = "embedding") -> DataFrame:
    """Means then population stds of equal blocks; an indivisible length fails the query."""
    n = F.size(values)
    size = (n / F.lit(blocks)).cast("int")
    stats = F.when(
        n % blocks == 0,
        F.transform(
            F.sequence(F.lit(0), F.lit(blocks - 1)),
            lambda b: central_moments(F.slice(values, b * size + 1, size)),
        ),
    ).otherwise(F.raise_error(F.lit("signal length is not divisible by the block count")))
    base = df.withColumn("_b", stats)
    means = F.transform("_b", lambda s: s["mean"])
    stds = F.transform("_b", lambda s: F.sqrt(s["m2"] / s["n"]))
    return base.withColumn(name, F.concat(means, stds)).drop("_b")


def cwt_embedding(rows: DataFrame, scales: int, bins: int, groups: int = 8, key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Pool (scale, bin, power) rows to groups x groups means."""
    if scales % groups or bins % groups:
        raise ValueError("scales and bins must be divisible by the pooling groups")
    cell_s = F.floor(F.col("scale") / F.lit(scales // groups)).cast("int")
    cell_b = F.floor(F.col("bin") / F.lit(bins // groups)).cast("int")
    return rows.groupBy(*key, cell_s.alias("scale_group"), cell_b.alias("time_group")).agg(F.avg("power").alias("power"))


def scale_frequency(scale: str | Column, rate_hz: float, w0: float = 6.0) -> Column:
    """Pseudo-frequency in Hz of a Morlet scale."""
    s = F.col(scale) if isinstance(scale, str) else scale
    return F.lit(rate_hz * w0 / (2.0 * math.pi)) / s


def resample(df: DataFrame, n: int, values: str = "values") -> DataFrame:
    """Fourier resampling to ``n`` samples."""
    if n < 2:
        raise ValueError("output length must be at least 2")

    @signal_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([kernels.fourier_resample(v[None, :], n)[0] for v in series])

    return df.withColumn(values, run(values))


# Class centroids ----------------------------------------------------------------------


def fit_centroids(df: DataFrame, embedding: str, target: str = "target", fold: str | None = None) -> DataFrame:
    """Mean vector per class; with ``fold``, one pair per fold that leaves the fold out.

    Sums per (class, fold, position) come from one aggregation; leaving a fold out is the
    total minus that fold's sums, so rows are read once whatever the number of folds.
    """
    keys = [target] + ([fold] if fold else [])
    sums = (
        df.select(*keys, F.posexplode(embedding).alias("pos", "_v"))
        .groupBy(*keys, "pos")
        .agg(F.sum("_v").alias("s"), F.count("_v").alias("n"))
    )
    if fold:
        # A few folds per (class, position): keep them as a map, then take each one away.
        all_folds = df.agg(F.sort_array(F.collect_set(fold)).alias("f")).scalar()
        own = F.map_from_entries(F.collect_list(F.struct(fold, F.struct("s", "n"))))
        totals = sums.groupBy(target, "pos").agg(F.sum("s").alias("_ts"), F.sum("n").alias("_tn"), own.alias("_own"))
        spread = totals.select(target, "pos", "_ts", "_tn", "_own", F.explode(all_folds).alias(fold))
        mine = F.try_element_at("_own", F.col(fold))
        sums = spread.select(
            *keys,
            "pos",
            (F.col("_ts") - F.coalesce(mine["s"], F.lit(0.0))).alias("s"),
            (F.col("_tn") - F.coalesce(mine["n"], F.lit(0))).alias("n"),
        )
    ordered = F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m"))))
    by_class = sums.groupBy(*keys).agg(F.transform(ordered, lambda e: e["m"]).alias("c"))
    pick = [F.max(F.when(F.col(target) == k, F.col("c"))).alias(f"centroid_{k}") for k in (0, 1)]
    return by_class.groupBy(*([fold] if fold else [])).agg(*pick)


def centroid_distance(df: DataFrame, centroids: DataFrame, embedding: str, fold: str | None = None, kind: str = "l2") -> DataFrame:
    """Distance of each row to the two centroids: L2 norm, or root mean square."""
    if fold:
        joined = df.join(centroids, fold)
    else:
        joined = df.withColumns({f"centroid_{k}": centroids.select(f"centroid_{k}").scalar() for k in (0, 1)})

    def distance(k: int) -> Column:
        squares = F.zip_with(embedding, f"centroid_{k}", lambda x, c: (x - c) * (x - c))
        total = array_sum(squares) if kind == "l2" else array_mean(squares)
        return F.sqrt(total).alias(f"distance_{k}")

    return joined.select(*df.columns, distance(0), distance(1))
