"""Models that are fitted together over blocks of rows: boosted trees, perceptrons, contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import fusion as fz
from sigloom.operators import boosting as bo
from sigloom.operators import contribution as co
from sigloom.operators import models as mo
from sigloom.operators import networks as nw
from sigloom.operators import projections as pr
from sigloom.operators import splits as sp
from sigloom.operators.blocks import Fit
from sigloom.plans import inputs as src
from sigloom.plans.model_queries import features, folded_pair
from sigloom.plans.registry import query, rounded

STOP_SHARE = 0.1


@query(
    "stop_sets",
    f"""WITH {src.TRIPLES}, u AS (SELECT sample_id, target, CAST(id_measurement % 5 AS INT) AS fold FROM triples),
      f AS (SELECT u.*, r.o AS outer_fold FROM u JOIN range(5) r(o) ON r.o <> u.fold),
      k AS (SELECT *, row_number() OVER (PARTITION BY outer_fold, target ORDER BY substr(md5('42|' || sample_id),1,8), sample_id) AS r, count(*) OVER (PARTITION BY outer_fold, target) AS n FROM f)
    SELECT CAST(outer_fold AS INT) AS outer_fold, sample_id, r <= round_even({STOP_SHARE}::DOUBLE * n, 0) AS stop FROM k""",
)
def stop_sets(spark, sf):
    rows = src.triples(spark, sf).withColumn("fold", F.pmod("id_measurement", F.lit(5)).cast("int"))
    return sp.stop_sets(rows, "fold", STOP_SHARE, 42)


@query("cross_fit_boosted")
def cross_fit_boosted(spark, sf):
    """Two hundred trees for each of five folds, grown in the same passes."""
    df, names = features(spark, sf)
    out = bo.cross_fit_boosted(sp.grouped_folds(df, 5, 42), names)
    return rounded(out.select("sample_id", "fold", "probability"))


def reliability_rows(spark, sf):
    """Inputs and outcome of the temporal expert's correctness, for every seed and fold."""
    p = folded_pair(spark, sf).withColumn("ok", (F.col("d_temporal") == F.col("target")).cast("int"))
    inputs = fz.reliability_features("p_temporal", "p_spectral")
    return p.select("sample_id", "seed", "fold", "ok", *[c.alias(n) for n, c in inputs.items()]), list(inputs)


def reliability_fits(names, stop_in=None):
    """A model for every seed and fold, and the place of the one that never saw a row."""
    fits, at = [], F.lit(None).cast("int")
    for seed in (42, 43, 44):
        for fold in range(5):
            outside = (F.col("seed") == seed) & (F.col("fold") != fold)
            stops = F.array_contains(stop_in, F.lit(fold)) if stop_in else F.lit(False)
            at = F.when((F.col("seed") == seed) & (F.col("fold") == fold), F.lit(len(fits))).otherwise(at)
            fits.append(Fit(tuple(names), outside & ~stops, outside & stops))
    return fits, at


def quality(scored, at):
    named = scored.withColumn("probability", F.get("scores", at))
    return rounded(mo.reliability_quality(named, ["seed"], "probability", "ok"))


@query("reliability_boosted")
def reliability_boosted(spark, sf):
    rows, names = reliability_rows(spark, sf)
    fits, at = reliability_fits(names)
    scored, _ = bo.fit_boosted(rows, "sample_id", "ok", fits, bo.BoostSpec(trees=120, l2=0.0))
    return quality(scored, at)


@query("reliability_networks")
def reliability_networks(spark, sf):
    """Perceptrons of 16 and 8 units that a fifth of the rows outside each fold stops."""
    rows, names = reliability_rows(spark, sf)
    marked = sp.with_stop_sets(rows, sp.stop_sets(rows, "fold", 0.2, 42, target="ok"))
    fits, at = reliability_fits(names, "stop_in")
    scored, _ = nw.fit_networks(marked, "sample_id", "ok", fits)
    return quality(scored, at)


def families(spark, sf):
    from sigloom.operators.audits import complete_groups
    from sigloom.operators.joins import keep_groups

    df, names = features(spark, sf)
    group_split = F.when(F.col("id_measurement") % 4 == 0, "validation").otherwise("train")
    df = df.withColumn("split", group_split)
    inventory = pr.feature_inventory(names)
    sets = {name: pr.feature_set(inventory, name) for name in pr.FEATURE_SETS}
    return {"phase_independent": df, "measurement_aware": keep_groups(df, complete_groups(df))}, sets


@query("family_contribution")
def family_contribution(spark, sf):
    """Both classifiers, both modes, three seeds, every feature set."""
    frames, sets = families(spark, sf)
    predictions = co.family_predictions(frames, sets, (42, 43, 44))
    return rounded(co.family_deltas(co.family_metrics(predictions)))


@query("family_predictions")
def family_predictions(spark, sf):
    """The validation rows of every run of the logistic classifier, as they were judged."""
    frames, sets = families(spark, sf)
    out = co.family_predictions(frames, sets, (42, 43, 44), ("logistic",))
    keep = ("sample_id", "phase", "target", "probability", "threshold", "prediction")
    return rounded(out.where("split = 'validation'").select(*co.RUN, *keep))
