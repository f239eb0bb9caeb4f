"""Leakage-safe splits and folds.

Assignment is by an md5 of (seed, id), so it depends on the keys alone: no random state,
the same on any cluster layout and after any retry. Positions within a stratum come from
the distributed rank, since one stratum usually holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.scalars import hash32
from sigloom.operators.ordering import attach, global_rank, ordered_prefix


def stratified_folds(
    df: DataFrame, k: int, seed: int, strata: Sequence[str] = ("target",), id_col: str = "sample_id", name: str = "fold"
) -> DataFrame:
    """Round-robin folds over the hash order within each stratum: sizes differ by at most one."""
    return _with_rank(df, seed, strata, id_col).withColumn(name, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def _with_rank(df: DataFrame, seed: int, strata: Sequence[str], id_col: str) -> DataFrame:
    """Adds ``_r``, the place in the hash order of the stratum. Only strata and ids are sorted;
    wide rows are joined to their rank by id."""
    narrow = [*strata, id_col]
    ranked = global_rank(df.select(*narrow, hash32(seed, id_col).alias("_h")), strata, ["_h", id_col], "_r")
    if set(df.columns) <= set(narrow):
        return ranked.select(*df.columns, "_r")
    ranks = ranked.select(F.col(id_col).alias("_id"), "_r")
    return df.join(ranks, F.col(id_col) == F.col("_id")).select(*df.columns, "_r")


def group_table(df: DataFrame, group: str = "id_measurement", target: str = "target") -> DataFrame:
    """One row per group; its stratum is the number of positive signals."""
    return df.groupBy(group).agg(F.count_if(F.col(target) == 1).alias("_stratum"))


def grouped_folds(df: DataFrame, k: int, seed: int, group: str = "id_measurement", target: str = "target", name: str = "fold") -> DataFrame:
    """Folds that never cut a group, stratified by the group's positives."""
    groups = stratified_folds(group_table(df, group, target), k, seed, ["_stratum"], group, name)
    return df.join(groups.select(group, name), group)


def grouped_manifest(df: DataFrame, seed: int = 42, k: int = 5, inner: int = 5, group: str = "id_measurement", target: str = "target") -> DataFrame:
    """60/20/20 split by group (outer fold 0 test, 1 validation, rest train) and OOF folds on train.

    All assignment happens on the group table; the signal rows are joined once.
    """
    outer = stratified_folds(group_table(df, group, target), k, seed, ["_stratum"], group, "_outer").withColumn(
        "split", F.when(F.col("_outer") == 0, "test").when(F.col("_outer") == 1, "validation").otherwise("train")
    )
    train = stratified_folds(outer.where("split = 'train'"), inner, seed + 1, ["_stratum"], group, "oof_fold")
    rest = outer.where("split <> 'train'").withColumn("oof_fold", F.lit(-1))
    assigned = train.unionByName(rest).select(group, "split", "oof_fold")
    return df.join(assigned, group).withColumn(
        "partition", F.when(F.col("split") == "train", "train").otherwise("heldout")
    )


def source_manifest(
    df: DataFrame, mapping: dict[str, str], k: int, seed: int, partition: str = "partition", target: str = "target", id_col: str = "sample_id"
) -> DataFrame:
    """Source partitions become split names; only train rows get folds (-1 elsewhere)."""
    split = F.lit(None).cast("string")
    for source, name in mapping.items():
        split = F.when(F.col(partition) == source, name).otherwise(split)
    named = df.withColumn("split", split)
    train = stratified_folds(named.where("split = 'train'"), k, seed, [target], id_col, "oof_fold")
    return train.unionByName(named.where("split <> 'train' OR split IS NULL").withColumn("oof_fold", F.lit(-1)))


def stratified_split(df: DataFrame, fraction: float, seed: int, target: str = "target", id_col: str = "sample_id") -> DataFrame:
    """Signal-level split with round(fraction * n) of each class in train (a leaky diagnostic)."""
    ranked = _with_rank(df, seed, [target], id_col)
    sizes = df.groupBy(target).agg(F.rint(F.lit(fraction) * F.count(F.lit(1))).alias("_cut"))
    placed = attach(ranked, sizes, [target])
    return placed.withColumn(
        "split", F.when(F.col("_r") <= F.col("_cut"), "train").otherwise("validation")
    ).drop("_r", "_cut")


def nested_folds(
    df: DataFrame, k: int, inner: int, seed: int, group: str | None = None, target: str = "target", id_col: str = "sample_id"
) -> DataFrame:
    """For every outer fold, inner folds of the rows outside it (by group when given).

    Rows repeat once per outer fold they are fitted in, k-1 times in all.
    """
    if group:
        unit = stratified_folds(group_table(df, group, target), k, seed, ["_stratum"], group, "outer_fold")
        key, strata = group, ["_stratum"]
    else:
        unit = stratified_folds(df.select(id_col, target), k, seed, [target], id_col, "outer_fold")
        key, strata = id_col, [target]
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("outer_fold"))
    fit = unit.select(key, *strata, F.explode(others).alias("outer"))
    folded = stratified_folds(fit, inner, seed + 1, ["outer", *strata], key, "inner_fold")
    return folded.select(F.col("outer").alias("outer_fold"), key, "inner_fold")


def validate_manifest(df: DataFrame, group: str = "id_measurement", id_col: str = "sample_id") -> DataFrame:
    """One report row; a sound manifest has zeros in every *_errors column and >= 2 folds."""
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("c"))
    overlap = (
        df.groupBy(group)
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .agg(F.count_if(F.col("lo") != F.col("hi")).alias("c"))
    )
    train = F.col("split") == "train"
    return (
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("split").isNull()).alias("unassigned_errors"),
            F.count_if(train & (F.col("oof_fold") < 0)).alias("uncovered_errors"),
            F.count_distinct(F.when(train, F.col("oof_fold"))).alias("oof_folds"),
        )
        .withColumn("duplicate_errors", ids.scalar())
        .withColumn("overlap_errors", overlap.scalar())
    )


def stop_sets(
    df: DataFrame, fold: str = "fold", share: float = 0.1, seed: int = 42, group: str | None = None,
    target: str = "target", id_col: str = "sample_id",
) -> DataFrame:
    """For every outer fold, a stratified ``share`` of the rows outside it (of whole groups when
    given), on which a fit decides when to stop: outer_fold, id, stop.

    A row of fold f is never in the stop set of f. Each stratum gives round(share * n) of its rows.
    """
    key, strata = (group, ["_stratum"]) if group else (id_col, [target])
    unit = df.groupBy(group, fold).agg(F.count_if(F.col(target) == 1).alias("_stratum")) if group else df.select(id_col, target, fold)
    folds = sorted(r[0] for r in unit.select(fold).distinct().collect()) or [0]
    inside = [F.when(F.col(fold) == F.lit(f), 1).otherwise(0).cast("bigint").alias(f"_n{i}") for i, f in enumerate(folds)]
    counted = unit.select(key, *strata, fold, hash32(seed, key).alias("_h"), *inside)
    # One order of all rows serves every outer fold: a place outside it is the sum of those in the other folds.
    names = [f"_n{i}" for i in range(len(folds))]
    ordered = ordered_prefix(counted, strata, ["_h", key], names)
    placed = attach(ordered, counted.groupBy(*strata).agg(*[F.sum(n).alias(f"{n}_all") for n in names]), strata)
    outside = lambda i, end: sum((F.col(n + end) for n in names if n != names[i]), F.lit(0))
    sets = F.array(*[
        F.struct(F.lit(f).alias("outer_fold"), (outside(i, "_before") < F.rint(F.lit(share) * outside(i, "_all"))).alias("stop")) for i, f in enumerate(folds)
    ])
    others = placed.select(key, F.explode(F.filter(sets, lambda s: s["outer_fold"] != F.col(fold))).alias("_set"))
    return others.select("_set.outer_fold", key, "_set.stop")


def with_stop_sets(df: DataFrame, sets: DataFrame, key: str = "sample_id", name: str = "stop_in") -> DataFrame:
    """Adds the array of outer folds for which a row is in the stop set."""
    held = sets.where("stop").groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_set("outer_fold")).alias(name))
    none = F.array().cast(held.schema[name].dataType)
    return df.join(held, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, none))
