"""Fusion rules for two experts' probabilities, as pure column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.scalars import ColumnLike, as_col, binary_entropy, clip, confidence, logit, margin, same_side


def mean_fusion(a: ColumnLike, b: ColumnLike) -> Column:
    return (as_col(a) + as_col(b)) / F.lit(2.0)


def weighted(a: ColumnLike, b: ColumnLike, weight: ColumnLike) -> Column:
    w = as_col(weight)
    return w * as_col(a) + (F.lit(1.0) - w) * as_col(b)


def adaptive_weights(ra: ColumnLike, rb: ColumnLike) -> tuple[Column, Column]:
    total = as_col(ra) + as_col(rb) + F.lit(1e-8)
    return as_col(ra) / total, as_col(rb) / total


def adaptive(a: ColumnLike, b: ColumnLike, ra: ColumnLike, rb: ColumnLike) -> Column:
    """Reliability-weighted mean of the two probabilities, kept in [0,1]."""
    wa, wb = adaptive_weights(ra, rb)
    return clip(wa * as_col(a) + wb * as_col(b), 0.0, 1.0)


def conservative(fixed: ColumnLike, adapted: ColumnLike, ra: ColumnLike, rb: ColumnLike, delta: ColumnLike) -> Column:
    """The fixed mixture unless the reliabilities differ by at least ``delta``."""
    close = F.abs(as_col(ra) - as_col(rb)) < as_col(delta)
    return F.when(close, as_col(fixed)).otherwise(as_col(adapted))


def entropy_fusion(a: ColumnLike, b: ColumnLike) -> Column:
    wa = F.lit(1.0) - binary_entropy(a) + F.lit(1e-6)
    wb = F.lit(1.0) - binary_entropy(b) + F.lit(1e-6)
    return (wa * as_col(a) + wb * as_col(b)) / (wa + wb)


def override(anchor: ColumnLike, alternative: ColumnLike, score: ColumnLike, tau: ColumnLike) -> Column:
    """The alternative's decision where the two differ and the gate score reaches ``tau``."""
    differ = as_col(anchor) != as_col(alternative)
    return F.when(differ & (as_col(score) >= as_col(tau)), as_col(alternative)).otherwise(as_col(anchor))


def reliability_features(a: ColumnLike, b: ColumnLike, eps: float = 1e-6) -> dict[str, Column]:
    """The 11 signal-level inputs of a reliability model."""
    a, b = clip(a, eps, 1.0 - eps), clip(b, eps, 1.0 - eps)
    return {
        "probability_a": a,
        "probability_b": b,
        "logit_a": logit(a, eps),
        "logit_b": logit(b, eps),
        "margin_a": margin(a),
        "margin_b": margin(b),
        "entropy_a": binary_entropy(a),
        "entropy_b": binary_entropy(b),
        "absolute_difference": F.abs(a - b),
        "signed_difference": a - b,
        "agreement": same_side(a, b),
    }


def full_reliability_features(
    logit_a: ColumnLike,
    logit_b: ColumnLike,
    a: ColumnLike,
    b: ColumnLike,
    extra: dict[str, ColumnLike] | None = None,
    distances: tuple[ColumnLike, ColumnLike, ColumnLike, ColumnLike] | None = None,
) -> dict[str, Column]:
    """13 expert inputs, then optional window/signal summaries and centroid distances.

    ``distances`` = (a to class 0, a to class 1, b to class 0, b to class 1).
    """
    pa, pb = as_col(a), as_col(b)
    out = {
        "logit_a": as_col(logit_a),
        "logit_b": as_col(logit_b),
        "probability_a": pa,
        "probability_b": pb,
        "margin_a": margin(pa),
        "margin_b": margin(pb),
        "entropy_a": binary_entropy(pa),
        "entropy_b": binary_entropy(pb),
        "confidence_a": confidence(pa),
        "confidence_b": confidence(pb),
        "absolute_difference": F.abs(pa - pb),
        "signed_difference": pa - pb,
        "agreement": same_side(pa, pb),
    }
    if distances:
        a0, a1, b0, b1 = (as_col(c) for c in distances)
        out |= {
            "distance_a_class0": a0, "distance_a_class1": a1,
            "distance_b_class0": b0, "distance_b_class1": b1,
            "centroid_margin_a": a0 - a1, "centroid_margin_b": b0 - b1,
        }
    for name, column in (extra or {}).items():
        out[name] = as_col(column)
    return out
