"""Scalar column functions shared by the score, signal and gate operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def clip(value: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def sigmoid(logit: ColumnLike) -> Column:
    """Logistic function; the logit is clipped to +-40 so exp never overflows."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(logit, -40.0, 40.0)))


def logit(probability: ColumnLike, eps: float = 1e-6) -> Column:
    p = clip(probability, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def softplus(value: ColumnLike) -> Column:
    """ln(1 + e^x) without overflow for large |x|."""
    x = as_col(value)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_entropy(probability: ColumnLike, eps: float = 1e-7) -> Column:
    """Entropy in bits of a Bernoulli(p), so 1.0 means a coin flip."""
    p = clip(probability, eps, 1.0 - eps)
    q = F.lit(1.0) - p
    return -(p * F.log2(p) + q * F.log2(q))


def margin(probability: ColumnLike) -> Column:
    return F.abs(as_col(probability) - F.lit(0.5))


def confidence(probability: ColumnLike) -> Column:
    p = as_col(probability)
    return F.greatest(p, F.lit(1.0) - p)


def same_side(a: ColumnLike, b: ColumnLike, cut: float = 0.5) -> Column:
    """1.0 when both probabilities fall on the same side of ``cut``."""
    return ((as_col(a) >= F.lit(cut)) == (as_col(b) >= F.lit(cut))).cast("double")


def wrap_degrees(value: ColumnLike) -> Column:
    """Map an angle to [-180, 180)."""
    return F.pmod(as_col(value) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def ratio(numerator: ColumnLike, denominator: ColumnLike, default: float = 0.0) -> Column:
    """Double division that yields ``default`` on a zero denominator (ANSI mode raises otherwise)."""
    n, d = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(d != F.lit(0.0), n / d).otherwise(F.lit(default))


def finite_or(value: ColumnLike, nan: Column | None, positive: Column | None, negative: Column | None) -> Column:
    x = as_col(value).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), nan)
        .when(x == F.lit(math.inf), positive)
        .when(x == F.lit(-math.inf), negative)
        .otherwise(x)
    )


def is_finite(value: ColumnLike) -> Column:
    x = as_col(value).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def hash32(*parts: ColumnLike | int) -> Column:
    """First 32 bits of md5 over '|'-joined parts, as a non-negative bigint.

    Used wherever a reproducible pseudo-random draw or ordering is needed: the value
    depends on the row's own keys only, so it survives task retries and repartitioning.
    """
    cols = [F.lit(str(p)) if isinstance(p, int) else as_col(p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")
