"""Exact global ordering without a one-task sort.

A plain ``Window.orderBy`` over a whole population sends every row of a key to one task.
Here rows are range-partitioned on (keys, order), each slice is summed on its own, and the
slice totals (at most one row per slice and key) give each slice its starting offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import cut_lineage

SLICE = "_slice"


def ordered_prefix(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    slices: int | None = None,
) -> DataFrame:
    """Add ``<c>_before`` (exclusive running sum of c within ``by``, ascending ``order``).

    ``order`` must be unique within ``by``; aggregate equal values first. The slice id is
    stored by a checkpoint, so totals and details agree even if an executor is lost.
    """
    by, order, sums = list(by), list(order), list(sums)
    keys = [F.col(c) for c in by + order]
    # Without a fixed number, adaptive execution merges small neighbouring ranges by size.
    spread = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    ranged = cut_lineage(spread.withColumn(SLICE, F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, SLICE)
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
        .select(
            *[F.col(c).alias(f"_k_{c}") for c in by],
            F.col(SLICE).alias("_k_slice"),
            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        )
    )
    on = [F.col(SLICE) == F.col("_k_slice")] + [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    inner = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(offsets, on, "inner")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{c}_before")
            for c in sums
        ],
    )


def attach(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-key summary columns: a join on the key, or scalar subqueries when there is none."""
    if by:
        return df.join(summary, list(by))
    return df.withColumns({c: summary.select(c).scalar() for c in summary.columns})


def global_rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position of every row within ``by``, ascending and unique on ``order``."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = ordered_prefix(counted, by, order, ["_one"])
    return ranked.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles of a population of any size, one row per ``by`` key.

    Equal values collapse to one row with a count before anything is ordered, so a value
    shared by a third of all rows costs one row, and no task holds the whole population.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = ordered_prefix(counts, by, [value], ["_n"])
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("_total"))
    located = attach(placed, totals, by)

    def value_at(rank):
        hit = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks = []
    for name, q in probs.items():
        position = F.lit(q) * (F.col("_total") - 1).cast("double")
        picks += [
            value_at(F.floor(position)).alias(f"_lo_{name}"),
            value_at(F.ceil(position)).alias(f"_hi_{name}"),
        ]
    picked = located.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    out = []
    for name, q in probs.items():
        position = F.lit(q) * (F.col("_total") - 1).cast("double")
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*by, *out)
