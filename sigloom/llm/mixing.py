"""Mixing sources to target token shares by entropy balancing.

Each document i of source s gets a rate r_i, chosen as close as possible to 1 in relative
entropy, the documents weighing size_i ** tilt, such that the sizes times the rates of each
source sum to its target and no rate exceeds the cap. The convex dual has one multiplier per
source and gives exponentially tilted rates r_i = min(cap, exp(lambda_s * z_i)) with
z_i = size_i ** (1 - tilt), scaled. Newton steps on the dual are sums over the documents.
Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.text import n_words
from sigloom.operators.ordering import global_rank
from sigloom.session import cut_lineage

#: A table of at most so many rows of a few numbers is joined by broadcast; a larger one by shuffle.
BROADCAST_ROWS = 20_000
#: Cells a unit into which the rounding draws of a source below 2 are counted, and cells a doubling
#: for those above. NEVER is behind them all, for documents whose rate is whole.
CELLS, HIGH_CELLS = 4096, 64
NEVER = 2 * CELLS + 64 * HIGH_CELLS


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words of every row; the size of a null text is 0."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def _with(df: DataFrame, table: DataFrame) -> DataFrame:
    """Join a per-source table to rows; null is a source like any other."""
    other = table.withColumnRenamed("source", "_source")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    return df.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def targets(sized: DataFrame, weights: Sequence[float], share: float, cap: int) -> DataFrame:
    """source, source_size and target: ``share`` of all sizes dealt by weight, no source above
    ``cap`` times its size. Sources are ordered by code point, null last, and the weights repeat.

    The excess of capped sources is dealt again until none is above, which is the level t with
    sum(min(cap * size_s, t * weight_s)) = share * sum(size_s); only t passes the driver.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    flagged = per_source.withColumn("_null", F.col("source").isNull().cast("int"))
    ranked = global_rank(flagged, [], ["_null", "source"], "_rank").drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut_lineage(ranked.select("source", "source_size", weight.alias("_weight")))
    top = F.col("source_size") * float(cap)
    sums = table.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    goal = share * float(sums["size"] or 0)
    level = goal / sums["weight"] if sums["weight"] else 0.0
    while True:
        over = F.col("_weight") * level > top
        row = table.agg(F.sum(F.when(over, top)).alias("full"), F.sum(F.when(~over, F.col("_weight"))).alias("open")).first()
        if not row["open"]:
            break
        raised = (goal - (row["full"] or 0.0)) / row["open"]
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", F.least(top, F.col("_weight") * level).alias("target"))


def balance(
    sized: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    tilt: float = 0.5,
    tolerance: float = 1e-9,
    steps: int = 100,
) -> DataFrame:
    """The rule of every source: source, source_size, target, and what ``copies`` needs.

    ``sized`` has doc_id, source and size and is read several times. Documents are first folded
    to counts per (source, size), so a hot source costs one row per distinct size. A step that
    leaves the bracket of the root is replaced by bisection; a source that has not reached
    ``tolerance`` after ``steps`` raises.
    """
    if cap != int(cap):
        raise ValueError("cap must be whole, since documents are copied whole")
    goals = targets(sized, weights, share, cap)
    z = F.pow(F.col("size").cast("double"), F.lit(1.0 - tilt))
    cells = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("z", z)
    cells = cut_lineage(cells.withColumn("mass", F.col("n") * F.col("size").cast("double")))
    scale = cells.groupBy("source").agg((F.sum(F.col("mass") * F.col("z")) / F.sum("mass")).alias("scale"))
    start = F.log(F.col("target") / F.col("source_size"))
    solved = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * float(cap))
    state = cut_lineage(
        _with(goals.where("source_size > 0"), scale).select(
            "source", "source_size", "target", "scale",
            F.when(F.col("target") <= 0, F.lit(-1e300)).when(solved, F.lit(1e300)).otherwise(start).alias("dual"),
            F.lit(-1e300).alias("low"), F.lit(1e300).alias("high"), solved.alias("done"),
        )
    )
    top = math.log(cap)
    for _ in range(steps):
        exponent = F.col("dual") * F.col("z") / F.col("scale")
        rate = F.exp(F.least(exponent, F.lit(top)))
        sums = _with(cells, state.where(~F.col("done"))).groupBy("source").agg(
            F.sum(F.col("mass") * rate).alias("got"),
            F.sum(F.when(exponent < top, F.col("mass") * rate * F.col("z") / F.col("scale"))).alias("slope"),
        ).select(F.col("source").alias("_s"), "got", "slope")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - gap / F.col("slope")
        middle = F.when(high >= 1e300, F.col("dual") + 1.0).when(low <= -1e300, F.col("dual") - 1.0).otherwise((low + high) / 2)
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        near = F.abs(gap) <= F.col("target") * tolerance
        keep = F.col("done") | F.coalesce(near, F.lit(True))
        state = cut_lineage(
            state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "scale",
                F.when(keep, F.col("dual")).when(inside, newton).otherwise(middle).alias("dual"),
                F.when(keep, F.col("low")).otherwise(low).alias("low"),
                F.when(keep, F.col("high")).otherwise(high).alias("high"),
                keep.alias("done"),
            )
        )
        if not state.where(~F.col("done")).limit(1).count():
            break
    else:
        raise RuntimeError(f"entropy balancing did not converge in {steps} steps")
    rule = state.select("source", "source_size", "target", "scale", "dual").unionByName(
        goals.where("source_size = 0").select(
            "source", "source_size", "target", F.lit(1.0).alias("scale"), F.lit(0.0).alias("dual")
        )
    )
    rule = cut_lineage(rule)
    # Rounding: whole copies first, then one more for the documents whose draw lies below a
    # limit, set where the source's words come nearest to its target: before any cell or behind it.
    cell = Window.partitionBy("source").orderBy("cell")
    drawn = _with(sized, rule).select("source", "target", "size", *_draw(cap, tilt))
    counted = drawn.groupBy("source", "cell").agg(
        F.sum("size").alias("size"), F.sum(F.col("size") * F.col("whole")).alias("whole"), F.first("target").alias("target")
    )
    before = F.coalesce(F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("whole").over(Window.partitionBy("source"))
    miss = F.abs(F.col("target") - F.col("whole_all") - F.col("before"))
    prefix = lambda cell, size: F.struct(cell.alias("cell"), size.alias("before"))
    limits = (
        counted.select("source", "cell", "size", "target", before.alias("before"), whole.alias("whole_all"))
        .where(F.col("cell") < NEVER)
        .select("source", "target", "whole_all", F.inline(F.array(
            prefix(F.col("cell"), F.col("before")), prefix(F.col("cell") + 1, F.col("before") + F.col("size"))
        )))
        .groupBy("source")
        .agg(F.min_by("cell", F.struct(miss, F.col("cell"))).alias("limit"))
    )
    limits = limits.withColumnRenamed("source", "_s")
    return cut_lineage(rule.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def _draw(cap: int, tilt: float) -> list[Column]:
    """rate, whole copies and the cell of the rounding draw of a row joined with its rule.

    The draw is a hash of the row divided by the fractional part of its rate: below 1 with
    exactly that probability. Draws of 2 and more, up to 1e12, have cells by their logarithm.
    """
    z = F.pow(F.col("size").cast("double"), F.lit(1.0 - tilt))
    rate = F.exp(F.least(F.col("dual") * z / F.col("scale"), F.lit(math.log(cap))))
    rate = F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0))
    whole = F.floor(rate + 1e-12)
    part = rate - whole
    spread = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "source", "size"), 11).cast("double") / float(1 << 53)
    draw = spread / part
    high = 2 * CELLS + F.floor(F.log2(F.greatest(draw, F.lit(2.0)) / 2) * HIGH_CELLS)
    cell = F.when(part > 1e-12, F.when(draw < 2, F.floor(draw * CELLS)).otherwise(high)).otherwise(F.lit(NEVER))
    return [rate.alias("rate"), whole.alias("whole"), cell.cast("long").alias("cell")]


def copies(sized: DataFrame, rule: DataFrame, cap: int = 2, tilt: float = 0.5) -> DataFrame:
    """``sized`` (doc_id, source, size, any others) with source_size, target, rate, copies, taken.

    A document is taken 0 to ``cap`` times, whole. Documents of size 0 are taken once. Rows with
    equal doc_id, source and size are drawn alike, and reruns agree.
    """
    names = [c for c in sized.columns if c not in ("source_size", "target", "rate", "copies", "taken")]
    drawn = _with(sized.select(*names), rule).select(*names, "source_size", "target", "limit", *_draw(cap, tilt))
    number = F.col("whole") + F.when(F.col("cell") < F.col("limit"), 1).otherwise(0)
    return drawn.select(*names, "source_size", "target", "rate", number.cast("int").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )
