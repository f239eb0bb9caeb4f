"""Bootstrap intervals for the MCC difference of two paired decisions.

Rows are folded before anything is drawn: signals to eight joint (label, a, b) states,
groups to their distinct state-count profiles. Drawing counts from a multinomial over
states or profiles has exactly the distribution of resampling the rows or groups, so the
cost per replicate does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.batches import signal_udf
from sigloom.functions.scalars import hash32
from sigloom.operators.metrics import joint_states, mcc_of_states
from sigloom.operators.ordering import attach, global_rank
from sigloom.session import cut_lineage, parallelism

STATES = [f"s{k}" for k in range(8)]
REPLICATES_PER_ROW = 250
#: Draws that one task makes and looks up in the md5 bootstraps.
DRAWS_PER_TASK = 2_000_000


def state_delta(prefix: str = "s") -> Column:
    return mcc_of_states("a", prefix) - mcc_of_states("b", prefix)


def _generator(seed: int, *parts: int) -> np.random.Generator:
    """One independent stream per (seed, key, replicate, bucket): a retried task redraws the same."""
    return np.random.default_rng([seed & 0xFFFFFFFF, *[int(p) & 0xFFFFFFFF for p in parts]])


def _spread(df: DataFrame, n: int) -> DataFrame:
    """One row per replicate, spread over the cluster."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    return rows.repartition(parallelism(df.sparkSession), "replicate")


def signal_replicates(
    pair: DataFrame, by: Sequence[str], target: str, a: str, b: str, n: int, seed: int = 42
) -> DataFrame:
    """(by, replicate, delta) when single signals are resampled."""
    states = joint_states(pair, by, target, a, b)
    key = F.xxhash64(*by) if by else F.lit(0).cast("bigint")

    @signal_udf("array<double>")
    def draw(counts: pd.Series, replicate: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for c, r, key_hash in zip(counts, replicate, k):
            c = np.asarray(c, dtype=float)
            out.append(_generator(seed, key_hash, r).multinomial(int(c.sum()), c / c.sum()).astype(float))
        return pd.Series(out)

    drawn = _spread(states, n).withColumn("_d", draw(F.array(*[F.col(s).cast("double") for s in STATES]), "replicate", key))
    return drawn.select(
        *by, "replicate", *[F.get("_d", F.lit(k)).alias(s) for k, s in enumerate(STATES)]
    ).select(*by, "replicate", state_delta().alias("delta"))


def group_profiles(pair: DataFrame, by: Sequence[str], group: str, target: str, a: str, b: str) -> DataFrame:
    """Distinct joint-state profiles of groups with how many groups share each.

    A group holding a third of all rows is eight partial counts per task; groups of three
    signals have at most 120 profiles whatever their number.
    """
    per_group = joint_states(pair, [*by, group], target, a, b)
    return per_group.groupBy(*by, *STATES).agg(F.count(F.lit(1)).alias("groups"))


def group_replicates(
    pair: DataFrame, by: Sequence[str], group: str, target: str, a: str, b: str, n: int, seed: int = 42, buckets: int = 8
) -> DataFrame:
    """(by, replicate, delta) when whole groups are resampled.

    Profiles are hashed into ``buckets`` parts. Each replicate first splits its G draws over
    the buckets, then every bucket draws its share on its own: exact at any number of
    profiles, and no task holds more than one bucket. The number of buckets is part of the
    random stream and is fixed by the caller, so a key's interval depends on that key alone;
    raise it for tables with millions of different profiles.
    """
    by = list(by)
    profiles = group_profiles(pair, by, group, target, a, b)
    key = F.xxhash64(*by) if by else F.lit(0).cast("bigint")
    placed = profiles.withColumn("_b", F.pmod(F.xxhash64(*STATES), F.lit(buckets)).cast("int")).withColumn("_key", key)
    packed = cut_lineage(placed.groupBy(*by, "_key", "_b").agg(
        F.sum("groups").alias("_w"),
        F.sort_array(
            F.collect_list(F.array(F.col("groups").cast("double"), *[F.col(s).cast("double") for s in STATES]))
        ).alias("_p"),
    ))
    weights = packed.groupBy(*by, "_key").agg(
        F.array_sort(F.collect_list(F.struct("_b", F.col("_w").cast("double").alias("w")))).alias("_s")
    )

    @signal_udf("array<long>")
    def split(shares: pd.Series, replicate: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for w, r, key_hash in zip(shares, replicate, k):
            w = np.asarray(w, dtype=float)
            out.append(_generator(seed, key_hash, r).multinomial(int(w.sum()), w / w.sum()))
        return pd.Series(out)

    @signal_udf("array<array<double>>")
    def draw(profile: pd.Series, tasks: pd.Series, bucket: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for p, todo, b_id, key_hash in zip(profile, tasks, bucket, k):
            table = np.stack(p)
            odds, states = table[:, 0] / table[:, 0].sum(), table[:, 1:]
            picked = np.stack(
                [_generator(seed, key_hash, t["replicate"], b_id + 1).multinomial(int(t["_m"]), odds) for t in todo]
            )
            ids = np.array([[float(t["replicate"])] for t in todo])
            out.append(list(np.hstack([ids, picked @ states])))
        return pd.Series(out)

    shares = _spread(weights, n).withColumn("_m", split(F.transform("_s", lambda e: e["w"]), "replicate", "_key"))
    ids = F.transform("_s", lambda e: e["_b"])
    per_bucket = shares.select(*by, "_key", "replicate", F.explode(F.arrays_zip(ids.alias("b"), F.col("_m").alias("m"))).alias("e"))
    per_bucket = per_bucket.select(*by, "_key", "replicate", F.col("e.b").alias("_b"), F.col("e.m").alias("_m")).where("_m > 0")
    # A bucket's profiles travel once per few hundred replicates, not once per replicate.
    tasks = per_bucket.groupBy(*by, "_key", "_b", F.floor(F.col("replicate") / REPLICATES_PER_ROW).alias("_chunk")).agg(
        F.collect_list(F.struct("replicate", "_m")).alias("_todo")
    )
    joined = tasks.join(packed.select("_key", "_b", "_p"), ["_key", "_b"])
    drawn = joined.select(*by, F.explode(draw("_p", "_todo", "_b", "_key")).alias("_d"))
    summed = drawn.groupBy(*by, F.get("_d", F.lit(0)).cast("int").alias("replicate")).agg(
        *[F.sum(F.get("_d", F.lit(k + 1))).alias(s) for k, s in enumerate(STATES)]
    )
    return summed.select(*by, "replicate", state_delta().alias("delta"))


def hashed_group_replicates(
    pair: DataFrame, by: Sequence[str], group: str, target: str, a: str, b: str, n: int, seed: int = 42
) -> DataFrame:
    """The same resampling with md5 draws, so another engine can reproduce every replicate.

    Draw j of replicate r takes group number hash(seed|key|r|j) mod G. It makes n x G rows,
    built from the group table where it lies; use ``group_replicates`` for large tables.
    Groups are dealt out by number, as many tasks as ``DRAWS_PER_TASK`` asks for; a task makes
    the draws of its groups, and each draw is sent once, to the task that holds the group it took.
    """
    by = list(by)
    per_group = cut_lineage(global_rank(joint_states(pair, [*by, group], target, a, b), by, [group], "_rank"))
    sizes = per_group.groupBy(*by).agg(F.count(F.lit(1)).alias("_g"))
    parts = max(parallelism(pair.sparkSession), -(-per_group.count() * n // DRAWS_PER_TASK))
    numbered = attach(per_group.withColumn("_i", F.col("_rank") - 1), sizes, by)
    dealt = numbered.select(*by, "_g", "_i", *STATES).repartition(parts, *by, "_i")
    draws = dealt.select(*by, "_g", F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    picks = draws.select(*by, "replicate", F.pmod(hash32(seed, *by, "replicate", "_j"), F.col("_g")).alias("_i"))
    # The hint keeps the group table from being sent whole, through the driver, to every task.
    joined = picks.repartition(parts, *by, "_i").join(dealt.drop("_g").hint("shuffle_hash"), [*by, "_i"])
    summed = joined.groupBy(*by, "replicate").agg(*[F.sum(s).alias(s) for s in STATES])
    return summed.select(*by, "replicate", state_delta().alias("delta"))


def hierarchical(replicates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average independent per-seed replicates into one delta per replicate."""
    return replicates.groupBy(*by, "replicate").agg(F.avg("delta").alias("delta"), F.count(F.lit(1)).alias("seeds"))


def summarize(replicates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, 95 % interval and share above zero over the (bounded) replicates."""
    return replicates.groupBy(*by).agg(
        F.avg("delta").alias("bootstrap_mean"),
        F.percentile("delta", F.lit(0.5)).alias("bootstrap_median"),
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("delta") > 0).cast("double")).alias("fraction_gt_zero"),
        F.count(F.lit(1)).alias("iterations"),
    )


def bootstrap_delta(
    pair: DataFrame, by: Sequence[str], target: str, a: str, b: str, n: int = 10_000, seed: int = 42, group: str | None = None
) -> DataFrame:
    """Point estimate and interval of MCC(a) - MCC(b), per key; resampling unit is the
    signal, or the group when one is named."""
    by = list(by)
    points = joint_states(pair, by, target, a, b).select(*by, state_delta().alias("point_estimate"))
    if group:
        reps = group_replicates(pair, by, group, target, a, b, n, seed)
    else:
        reps = signal_replicates(pair, by, target, a, b, n, seed)
    return attach(summarize(reps, by), points, by)


def hierarchical_delta_ci(
    pair: DataFrame, target: str, a: str, b: str, n: int = 10_000, seed: int = 42, group: str | None = None, seeds: str = "seed"
) -> DataFrame:
    """Interval of the mean delta over training seeds, each resampled on its own."""
    points = joint_states(pair, [seeds], target, a, b).agg(F.avg(state_delta()).alias("point_estimate"), F.count(F.lit(1)).alias("seed_count"))
    if group:
        reps = group_replicates(pair, [seeds], group, target, a, b, n, seed)
    else:
        reps = signal_replicates(pair, [seeds], target, a, b, n, seed)
    return attach(summarize(hierarchical(reps)), points, [])
