"""Contract checks.

``require_*`` helpers add a check to the plan itself: a violating row raises while the
query runs, with no separate job. ``assert_*`` helpers run a small action at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks a declared contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Keep every row, or fail the query on the first row that breaks ``condition``."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique_rows(df: DataFrame, keys: Sequence[str], message: str | None = None) -> DataFrame:
    """The same rows, failing the query if a key repeats.

    Shuffles on the key once; a join on that key afterwards reuses the partitioning.
    Copies of a hot key are folded map-side, so they never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in rest]
    )
    checked = require(folded, F.col("_copies") == 1, message or f"duplicate key {list(keys)}")
    return checked.select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    sample = duplicate_keys(df, keys).take(3)
    if sample:
        raise ContractError(f"duplicate key {list(keys)}: {[tuple(r) for r in sample]}")


def assert_empty(df: DataFrame, message: str) -> None:
    sample = df.take(3)
    if sample:
        raise ContractError(f"{message}: {[tuple(r) for r in sample]}")
