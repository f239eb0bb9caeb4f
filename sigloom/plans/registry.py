"""Query catalogue: name -> Spark callable, and name -> equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Means of exact fractions often lie half way between two roundings, where sums taken in
# another order fall to the other side. Both engines round after the same small nudge.
NUDGE = {6: 1e-10, 9: 1e-13}


def round_to(column: Column, digits: int = 6) -> Column:
    return F.round(column + F.lit(NUDGE[digits]), digits)


def nudged(sql: str) -> str:
    """``round(x, 6)`` -> ``round(x + 1e-10, 6)``, and likewise for 9 digits."""
    for digits, step in NUDGE.items():
        sql = re.sub(rf",\s*{digits}\)", f" + {step!r}, {digits})", sql)
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = nudged(sql.strip())
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double so two engines that sum in different orders agree."""
    return df.select(
        *[
            (round_to(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )
