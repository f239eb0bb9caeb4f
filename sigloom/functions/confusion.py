"""Confusion-count aggregates and the rates derived from them.

Counts come out of one partial+final aggregation; every rate is plain column arithmetic
on those counts. Products are taken in double: four bigint margins multiplied together
overflow from a few hundred thousand rows on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.scalars import ColumnLike, as_col, ratio

COUNT_NAMES = ("tn", "fp", "fn", "tp")


def decision(probability: ColumnLike = "probability", threshold: ColumnLike = "threshold") -> Column:
    return (as_col(probability) >= as_col(threshold)).cast("int")


def confusion_counts(target: ColumnLike, prediction: ColumnLike) -> list[Column]:
    y, d = as_col(target), as_col(prediction)
    return [
        F.count_if((y == 0) & (d == 0)).alias("tn"),
        F.count_if((y == 0) & (d == 1)).alias("fp"),
        F.count_if((y == 1) & (d == 0)).alias("fn"),
        F.count_if((y == 1) & (d == 1)).alias("tp"),
    ]


def mcc(tp: ColumnLike = "tp", tn: ColumnLike = "tn", fp: ColumnLike = "fp", fn: ColumnLike = "fn") -> Column:
    """Matthews correlation; 0 when any margin is empty."""
    tp, tn, fp, fn = (as_col(c).cast("double") for c in (tp, tn, fp, fn))
    denominator = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, denominator)


def rates() -> list[Column]:
    """All hard-decision rates over columns named tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNT_NAMES)
    n = tn + fp + fn + tp
    return [
        mcc().alias("mcc"),
        ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn).alias("f1"),
        ratio(tp + fp, n).alias("positive_fraction"),
        (F.col("fp") + F.col("fn")).alias("errors"),
    ]
