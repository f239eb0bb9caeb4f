"""Native array reducers. Each makes a single pass over an existing array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.scalars import ColumnLike, as_col


def array_sum(values: ColumnLike, fn=lambda x: x) -> Column:
    return F.aggregate(as_col(values), F.lit(0.0), lambda acc, x: acc + fn(x.cast("double")))


def array_mean(values: ColumnLike, fn=lambda x: x) -> Column:
    return array_sum(values, fn) / F.size(as_col(values)).cast("double")


def quantile_of_sorted(sorted_values: ColumnLike, q: float) -> Column:
    """Linear-interpolation quantile of an ascending array column."""
    a = as_col(sorted_values)
    pos = F.lit(q) * (F.size(a) - 1).cast("double")
    low = F.floor(pos).cast("int")
    high = F.ceil(pos).cast("int")
    at_low, at_high = F.get(a, low), F.get(a, high)
    return at_low + (at_high - at_low) * (pos - low.cast("double"))


def top_k_mean(values: ColumnLike, fraction: float) -> Column:
    """Mean of the k largest entries, k = max(1, ceil(fraction * n))."""
    a = as_col(values)
    k = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.size(a)).cast("int"))
    return array_mean(F.slice(F.sort_array(a, asc=False), F.lit(1), k))


def rotate(values: ColumnLike, origin: ColumnLike) -> Column:
    """Circular shift that moves index ``origin`` to the front."""
    a, o = as_col(values), as_col(origin).cast("int")
    return F.concat(F.slice(a, o + 1, F.size(a)), F.slice(a, F.lit(1), o))


def zero_crossings(values: ColumnLike, rising: bool) -> Column:
    """Indices i where the series crosses zero between i-1 and i."""
    a = as_col(values)

    def crosses(i: Column) -> Column:
        before, after = F.get(a, i - 1), F.get(a, i)
        return ((before <= 0) & (after > 0)) if rising else ((before >= 0) & (after < 0))

    return F.when(F.size(a) < 2, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), crosses)
    )


def central_moments(values: ColumnLike) -> Column:
    """One-pass struct(n, mean, m2, m3, m4): central power sums updated per element."""
    a = as_col(values)
    zero = F.struct(*[F.lit(0.0).alias(name) for name in ("n", "mean", "m2", "m3", "m4")])

    def step(acc: Column, x: Column) -> Column:
        n0, n = acc["n"], acc["n"] + 1.0
        d = x.cast("double") - acc["mean"]
        dn = d / n
        term = d * dn * n0
        return F.struct(
            n.alias("n"),
            (acc["mean"] + dn).alias("mean"),
            (acc["m2"] + term).alias("m2"),
            (acc["m3"] + term * dn * (n - 2.0) - 3.0 * dn * acc["m2"]).alias("m3"),
            (
                acc["m4"] + term * dn * dn * (n * n - 3.0 * n + 3.0) + 6.0 * dn * dn * acc["m2"] - 4.0 * dn * acc["m3"]
            ).alias("m4"),
        )

    return F.aggregate(a, zero, step)


def peak_abs(values: ColumnLike) -> Column:
    a = as_col(values)
    return F.greatest(F.abs(F.array_max(a)), F.abs(F.array_min(a)))
