"""Operating-point searches, fusion rules and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import fusion as fz
from sigloom.functions.scalars import binary_entropy, confidence, logit
from sigloom.operators import splits as sp
from sigloom.operators import sweeps as sw
from sigloom.plans import inputs as src
from sigloom.plans.metric_queries import RATES, SQL_MCC, sql_mcc_of
from sigloom.plans.registry import query, rounded

CURVE = """
  curve AS (SELECT {by}, k, k / 200.0::DOUBLE AS threshold, sum(CAST(target=0 AND p < k/200.0::DOUBLE AS INT))::DOUBLE AS tn,
     sum(CAST(target=0 AND p >= k/200.0::DOUBLE AS INT))::DOUBLE AS fp, sum(CAST(target=1 AND p < k/200.0::DOUBLE AS INT))::DOUBLE AS fn,
     sum(CAST(target=1 AND p >= k/200.0::DOUBLE AS INT))::DOUBLE AS tp
     FROM {t}, range(10, 191) r(k) GROUP BY ALL),
  scored AS (SELECT *, """ + SQL_MCC.format(tp="tp", tn="tn", fp="fp", fn="fn") + """ AS mcc FROM curve),
  marked AS (SELECT *, max(mcc) OVER (PARTITION BY {by}) AS top FROM scored),
  points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY abs(k-100), k) AS rn FROM marked
      WHERE abs(mcc-top) <= 1e-8 + 1e-5*abs(top)) WHERE rn = 1)
"""


@query(
    "threshold_curve",
    f"""WITH {src.PREDICTIONS}, named AS (SELECT *, probability AS p FROM predictions), {CURVE.format(by='seed, method', t='named')}
    SELECT seed, method, CAST(k AS INT) AS k, threshold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, {RATES} FROM curve""",
)
def threshold_curve(spark, sf):
    return rounded(sw.threshold_curve(src.predictions(spark, sf), ["seed", "method"]))


@query(
    "select_threshold",
    f"""WITH {src.PREDICTIONS}, named AS (SELECT *, probability AS p FROM predictions), {CURVE.format(by='seed, split, method', t='named')}
    SELECT seed, split, method, CAST(k AS INT) AS k, threshold, round(mcc, 6) AS mcc FROM points""",
)
def select_threshold(spark, sf):
    return rounded(sw.select_threshold(src.predictions(spark, sf), ["seed", "split", "method"]))


@query(
    "select_threshold_first",
    f"""WITH {src.PREDICTIONS}, named AS (SELECT *, probability AS p FROM predictions), {CURVE.format(by='seed, method', t='named')}
    SELECT seed, method, CAST(min(k) AS INT) AS k, min(threshold) AS threshold, round(max(mcc), 6) AS mcc FROM marked WHERE mcc = top GROUP BY seed, method""",
)
def select_threshold_first(spark, sf):
    return rounded(sw.select_threshold(src.predictions(spark, sf), ["seed", "method"], tie="first"))


@query(
    "line_threshold",
    f"""WITH {src.LINES}, named AS (SELECT *, probability AS p FROM lines), {CURVE.format(by='method', t='named')}
    SELECT method, CAST(k AS INT) AS k, threshold, round(mcc, 6) AS mcc FROM points""",
)
def line_threshold(spark, sf):
    return rounded(sw.select_threshold(src.lines(spark, sf), ["method"]))


@query(
    "select_fixed_weight",
    f"""WITH {src.PAIR}, named AS (SELECT seed, target, w, (w/20.0::DOUBLE)*p_temporal + (1.0::DOUBLE-(w/20.0::DOUBLE))*p_spectral AS p
         FROM pair, range(21) r(w) WHERE split='train_oof'), {CURVE.format(by='seed, w', t='named')}
    SELECT seed, CAST(w AS INT) AS w, CAST(k AS INT) AS k, threshold, round(mcc,6) AS mcc, w/20.0::DOUBLE AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, abs(w-10), w) AS pick FROM points) WHERE pick = 1""",
)
def select_fixed_weight(spark, sf):
    p = src.pair(spark, sf).where("split = 'train_oof'")
    return rounded(sw.select_fixed_weight(p, ["seed"], "p_temporal", "p_spectral"))


@query(
    "weight_curve_validation",
    f"""WITH {src.PAIR}, mixed AS (SELECT seed, split, target, w, (w/20.0::DOUBLE)*p_temporal + (1.0::DOUBLE-(w/20.0::DOUBLE))*p_spectral AS p FROM pair, range(21) r(w)),
      named AS (SELECT * FROM mixed WHERE split='train_oof'), {CURVE.format(by='seed, w', t='named')},
      v AS (SELECT m.seed, m.w, target, CAST(m.p >= threshold AS INT) AS d FROM mixed m JOIN points q ON m.seed=q.seed AND m.w=q.w WHERE m.split='validation'),
      vm AS (SELECT seed, w, {sql_mcc_of('d')} AS validation_mcc FROM v GROUP BY seed, w)
    SELECT q.seed, CAST(q.w AS INT) AS w, threshold, round(mcc,6) AS oof_mcc, round(validation_mcc,6) AS validation_mcc FROM points q JOIN vm USING (seed, w)""",
)
def weight_curve_validation(spark, sf):
    """Weights and thresholds chosen on OOF rows only; validation MCC reported beside them."""
    from sigloom.functions.confusion import confusion_counts, mcc

    p = src.pair(spark, sf)
    points = sw.weight_curve(p.where("split = 'train_oof'"), ["seed"], "p_temporal", "p_spectral")
    held = p.where("split = 'validation'").join(points.select("seed", "w", "weight", "threshold", "mcc"), "seed")
    decided = held.withColumn("_d", (fz.weighted("p_temporal", "p_spectral", "weight") >= F.col("threshold")).cast("int"))
    counts = decided.groupBy("seed", "w", "threshold", F.col("mcc").alias("oof_mcc")).agg(*confusion_counts("target", "_d"))
    return rounded(counts.select("seed", "w", "threshold", "oof_mcc", mcc().alias("validation_mcc")))


@query(
    "fit_temperature",
    f"""WITH {src.PAIR}, z AS (SELECT seed, target, step, exp(ln(0.25::DOUBLE) + (ln(4.0::DOUBLE)-ln(0.25::DOUBLE))/80*step) AS temperature,
        ln(least(greatest(p_temporal,1e-6),1-1e-6)/(1-least(greatest(p_temporal,1e-6),1-1e-6))) AS x FROM pair, range(81) r(step)),
      c AS (SELECT seed, step, max(temperature) AS temperature, avg(greatest(x/temperature,0)+ln(1+exp(-abs(x/temperature))) - target*x/temperature) AS nll FROM z GROUP BY seed, step)
    SELECT seed, CAST(step AS INT) AS step, round(temperature,6) AS temperature, round(nll,6) AS nll FROM (
      SELECT *, row_number() OVER (PARTITION BY seed ORDER BY nll, step) AS rn FROM c) WHERE rn=1""",
)
def fit_temperature(spark, sf):
    p = src.pair(spark, sf).withColumn("x", logit("p_temporal"))
    return rounded(sw.fit_temperature(p, ["seed"], "x"))


@query(
    "temperature_curve",
    f"""WITH {src.PAIR}, z AS (SELECT seed, target, step, exp(ln(0.25::DOUBLE) + (ln(4.0::DOUBLE)-ln(0.25::DOUBLE))/160*step) AS temperature,
        ln(least(greatest(p_spectral,1e-6),1-1e-6)/(1-least(greatest(p_spectral,1e-6),1-1e-6))) AS x FROM pair, range(161) r(step))
    SELECT seed, CAST(step AS INT) AS step, round(max(temperature),6) AS temperature,
      round(avg(greatest(x/temperature,0)+ln(1+exp(-abs(x/temperature))) - target*x/temperature),6) AS nll FROM z GROUP BY seed, step""",
)
def temperature_curve(spark, sf):
    p = src.pair(spark, sf).withColumn("x", logit("p_spectral"))
    return rounded(sw.temperature_curve(p, ["seed"], "x", points=161))


FUSED = f"""{src.PAIR}, r AS (SELECT *, greatest(p_temporal,1-p_temporal) AS rt, greatest(p_spectral,1-p_spectral) AS rs FROM pair),
   h AS (SELECT *, least(greatest(p_temporal,1e-7),1-1e-7) AS ct, least(greatest(p_spectral,1e-7),1-1e-7) AS cs FROM r),
   e AS (SELECT *, 1+(ct*log2(ct)+(1-ct)*log2(1-ct))+1e-6 AS wt, 1+(cs*log2(cs)+(1-cs)*log2(1-cs))+1e-6 AS ws FROM h),
   fused AS (SELECT sample_id, seed, split, target, rt, rs, p_temporal, p_spectral, (p_temporal+p_spectral)/2 AS p_mean, 0.35::DOUBLE*p_temporal+0.65::DOUBLE*p_spectral AS p_fixed,
     least(greatest((rt/(rt+rs+1e-8))*p_temporal + (rs/(rt+rs+1e-8))*p_spectral, 0), 1) AS p_adaptive,
     (wt*p_temporal+ws*p_spectral)/(wt+ws) AS p_entropy FROM e)"""


def fused(spark, sf):
    p = src.pair(spark, sf).withColumns({"rt": confidence("p_temporal"), "rs": confidence("p_spectral")})
    return p.withColumns(
        {
            "p_mean": fz.mean_fusion("p_temporal", "p_spectral"),
            "p_fixed": F.lit(0.35) * F.col("p_temporal") + F.lit(0.65) * F.col("p_spectral"),
            "p_adaptive": fz.adaptive("p_temporal", "p_spectral", "rt", "rs"),
            "p_entropy": fz.entropy_fusion("p_temporal", "p_spectral"),
        }
    )


@query(
    "fusion_rules",
    f"""WITH {FUSED} SELECT sample_id, round(p_mean,9) AS p_mean, round(p_adaptive,9) AS p_adaptive, round(p_entropy,9) AS p_entropy,
      round(CASE WHEN abs(rt-rs) < 0.1 THEN p_fixed ELSE p_adaptive END,9) AS p_conservative FROM fused""",
)
def fusion_rules(spark, sf):
    df = fused(spark, sf).withColumn("p_conservative", fz.conservative("p_fixed", "p_adaptive", "rt", "rs", F.lit(0.1)))
    return rounded(df.select("sample_id", "p_mean", "p_adaptive", "p_entropy", "p_conservative"), 9)


@query(
    "select_delta",
    f"""WITH {FUSED}, named AS (SELECT seed, delta, target, CASE WHEN abs(rt-rs) < delta THEN p_fixed ELSE p_adaptive END AS p
        FROM fused, (VALUES (0.0::DOUBLE),(0.02::DOUBLE),(0.05::DOUBLE),(0.1::DOUBLE),(0.15::DOUBLE),(0.2::DOUBLE),(0.25::DOUBLE)) d(delta)),
      {CURVE.format(by='seed, delta', t='named')}
    SELECT seed, delta, CAST(k AS INT) AS k, threshold, round(mcc,6) AS mcc FROM (
      SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, delta) AS pick FROM points) WHERE pick = 1""",
)
def select_delta(spark, sf):
    return rounded(sw.select_delta(fused(spark, sf), ["seed"], "p_fixed", "p_adaptive", "rt", "rs"))


GATE = """named AS (SELECT seed, target, d_temporal AS a, d_spectral AS b, 1-abs(p_temporal-p_spectral)/2 AS score FROM pair),
   o AS (SELECT seed, k, target, a, b, (a<>b AND score >= k/200.0::DOUBLE) AS fired, CASE WHEN a<>b AND score >= k/200.0::DOUBLE THEN b ELSE a END AS f FROM named, range(100,191) r(k)),
   gate AS (SELECT seed, k, """ + sql_mcc_of("f") + """ AS mcc, count(*) FILTER (fired) AS overrides, count(*) FILTER (fired AND a<>target) AS beneficial,
      count(*) FILTER (fired AND a=target) AS harmful FROM o GROUP BY seed, k),
   sweep AS (SELECT *, CASE WHEN overrides>0 THEN beneficial/overrides ELSE 0 END AS override_precision FROM gate)"""


def gated(spark, sf):
    score = F.lit(1.0) - F.abs(F.col("p_temporal") - F.col("p_spectral")) / 2
    return src.pair(spark, sf).withColumn("score", score)


@query(
    "override_curve",
    f"""WITH {src.PAIR}, {GATE} SELECT seed, CAST(k AS INT) AS k, k/200.0::DOUBLE AS tau, round(mcc,6) AS mcc, overrides, beneficial, harmful,
      round(override_precision,6) AS override_precision FROM sweep""",
)
def override_curve(spark, sf):
    return rounded(sw.override_curve(gated(spark, sf), ["seed"], "target", "d_temporal", "d_spectral", "score"))


@query(
    "select_tau",
    f"""WITH {src.PAIR}, {GATE} SELECT seed, CAST(k AS INT) AS k, k/200.0::DOUBLE AS tau, round(mcc,6) AS mcc, overrides, beneficial, harmful,
      round(override_precision,6) AS override_precision FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, override_precision DESC, k) AS rn FROM sweep) WHERE rn=1""",
)
def select_tau(spark, sf):
    return rounded(sw.select_tau(gated(spark, sf), ["seed"], "target", "d_temporal", "d_spectral", "score"))


@query(
    "best_individual",
    f"""WITH {src.PREDICTIONS}, named AS (SELECT *, probability AS p FROM predictions), {CURVE.format(by='seed, method', t='named')}
    SELECT seed, method, CAST(k AS INT) AS k, threshold, round(mcc,6) AS mcc FROM (
      SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, method DESC) AS pick FROM points) WHERE pick=1""",
)
def best_individual(spark, sf):
    return rounded(sw.best_individual(src.predictions(spark, sf), ["seed"]))


@query(
    "candidate_scores",
    f"""WITH {src.PREDICTIONS}, named AS (SELECT *, probability AS p FROM predictions WHERE split='train_oof'), {CURVE.format(by='seed, method', t='named')},
      d AS (SELECT p.seed, p.method, p.split, p.target, q.threshold AS cut, CAST(p.probability >= q.threshold AS INT) AS d FROM predictions p JOIN points q USING (seed, method)),
      per AS (SELECT seed, method, split, max(cut) AS cut, {sql_mcc_of('d')} AS mcc FROM d GROUP BY seed, method, split),
      w AS (SELECT seed, method, max(cut) AS threshold, max(CASE WHEN split='train_oof' THEN mcc END) AS o, max(CASE WHEN split='validation' THEN mcc END) AS v FROM per GROUP BY seed, method)
    SELECT seed, method, threshold, round(o,6) AS oof_mcc, round(v,6) AS validation_mcc, round(max(v) OVER (PARTITION BY seed),6) AS best_individual_mcc,
      round(min(v) OVER (PARTITION BY seed),6) AS minimum_expert_mcc FROM w""",
)
def candidate_scores(spark, sf):
    return rounded(sw.candidate_scores(src.predictions(spark, sf)))


@query(
    "reliability_features",
    f"""WITH {src.PAIR}, c AS (SELECT sample_id, least(greatest(p_temporal,1e-6),1-1e-6) AS a, least(greatest(p_spectral,1e-6),1-1e-6) AS b FROM pair)
    SELECT sample_id, round(a,6) AS probability_a, round(b,6) AS probability_b, round(ln(a/(1-a)),6) AS logit_a, round(ln(b/(1-b)),6) AS logit_b,
      round(abs(a-0.5),6) AS margin_a, round(abs(b-0.5),6) AS margin_b, round(-(a*log2(a)+(1-a)*log2(1-a)),6) AS entropy_a, round(-(b*log2(b)+(1-b)*log2(1-b)),6) AS entropy_b,
      round(abs(a-b),6) AS absolute_difference, round(a-b,6) AS signed_difference, CAST((a>=0.5)=(b>=0.5) AS INT)::DOUBLE AS agreement FROM c""",
)
def reliability_features(spark, sf):
    cols = fz.reliability_features("p_temporal", "p_spectral")
    return rounded(src.pair(spark, sf).select("sample_id", *[c.alias(n) for n, c in cols.items()]))


@query(
    "entropy_shares",
    f"""WITH {src.PAIR}, c AS (SELECT split, target, least(greatest(p_temporal,1e-7),1-1e-7) AS a FROM pair)
    SELECT split, target, round(avg(-(a*log2(a)+(1-a)*log2(1-a))),6) AS mean_entropy FROM c GROUP BY ALL""",
)
def entropy_shares(spark, sf):
    return rounded(src.pair(spark, sf).groupBy("split", "target").agg(F.avg(binary_entropy("p_temporal")).alias("mean_entropy")))


# Splits -------------------------------------------------------------------------------

H = "('0x' || substr(md5('{seed}|' || CAST({id} AS VARCHAR)),1,8))::BIGINT"


def h(seed, col):
    return H.format(seed=seed, id=col)


@query(
    "stratified_folds",
    f"""WITH {src.PAIR} SELECT sample_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY {h(42, 'sample_id')}, sample_id) - 1) % 5 AS INT) AS fold FROM pair""",
)
def stratified_folds(spark, sf):
    return sp.stratified_folds(src.pair(spark, sf).select("sample_id", "target"), 5, 42)


GROUPS = f"""g AS (SELECT id_measurement, count(*) FILTER (target=1) AS s FROM triples GROUP BY 1),
   outr AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY {h(42, 'id_measurement')}, id_measurement) - 1) % 5 AS f FROM g),
   sp AS (SELECT *, CASE f WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM outr)"""


@query(
    "grouped_manifest",
    f"""WITH {src.TRIPLES}, {GROUPS}, inr AS (SELECT id_measurement, CAST((row_number() OVER (PARTITION BY s ORDER BY {h(43, 'id_measurement')}, id_measurement) - 1) % 5 AS INT) AS oof_fold
        FROM sp WHERE split='train')
    SELECT sample_id, id_measurement, phase, target, split, coalesce(oof_fold, -1) AS oof_fold, CASE WHEN split='train' THEN 'train' ELSE 'heldout' END AS partition
    FROM triples JOIN sp USING (id_measurement) LEFT JOIN inr USING (id_measurement)""",
)
def grouped_manifest(spark, sf):
    t = src.triples(spark, sf).select("sample_id", "id_measurement", "phase", "target")
    return sp.grouped_manifest(t)


@query(
    "validate_manifest",
    f"""WITH {src.TRIPLES} SELECT count(*) AS rows, 0::BIGINT AS unassigned_errors, 0::BIGINT AS uncovered_errors, 5::BIGINT AS oof_folds,
      0::BIGINT AS duplicate_errors, 0::BIGINT AS overlap_errors FROM triples""",
)
def validate_manifest(spark, sf):
    return sp.validate_manifest(grouped_manifest(spark, sf))


@query(
    "grouped_folds",
    f"""WITH {src.TRIPLES}, g AS (SELECT id_measurement, count(*) FILTER (target=1) AS s FROM triples GROUP BY 1),
      f AS (SELECT id_measurement, CAST((row_number() OVER (PARTITION BY s ORDER BY {h(7, 'id_measurement')}, id_measurement) - 1) % 5 AS INT) AS fold FROM g)
    SELECT sample_id, id_measurement, target, fold FROM triples JOIN f USING (id_measurement)""",
)
def grouped_folds(spark, sf):
    t = src.triples(spark, sf).select("sample_id", "id_measurement", "target")
    return sp.grouped_folds(t, 5, 7)


@query(
    "source_manifest",
    f"""WITH p AS (SELECT o_orderkey AS sample_id, o_orderstatus AS part, CAST(o_totalprice > 200000 AS INT) AS target FROM orders),
      s AS (SELECT *, CASE part WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation' ELSE 'test' END AS split FROM p)
    SELECT sample_id, target, part AS partition, split, CASE WHEN split='train' THEN
      CAST((row_number() OVER (PARTITION BY split, target ORDER BY {h(42, 'sample_id')}, sample_id) - 1) % 5 AS INT) ELSE -1 END AS oof_fold FROM s""",
)
def source_manifest(spark, sf):
    o = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") > 200000).cast("int").alias("target"), F.col("o_orderstatus").alias("partition")
    )
    return sp.source_manifest(o, {"F": "train", "O": "validation", "P": "test"}, 5, 42)


@query(
    "stratified_split",
    f"""WITH {src.TRIPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h(42, 'sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY target) AS n FROM triples)
    SELECT sample_id, id_measurement, target, CASE WHEN r <= round_even(0.75*n, 0) THEN 'train' ELSE 'validation' END AS split FROM r""",
)
def stratified_split(spark, sf):
    t = src.triples(spark, sf).select("sample_id", "id_measurement", "target")
    return sp.stratified_split(t, 0.75, 42)


@query(
    "stratified_split_overlap",
    f"""WITH {src.TRIPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {h(42, 'sample_id')}, sample_id) AS r, count(*) OVER (PARTITION BY target) AS n FROM triples),
      s AS (SELECT id_measurement, CASE WHEN r <= round_even(0.75*n, 0) THEN 'train' ELSE 'validation' END AS split FROM r)
    SELECT id_measurement, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""",
)
def stratified_split_overlap(spark, sf):
    from sigloom.operators.joins import group_overlap

    return group_overlap(stratified_split(spark, sf))


@query(
    "nested_folds",
    f"""WITH {src.TRIPLES}, {GROUPS}, fit AS (SELECT id_measurement, s, o FROM sp, range(5) r(o) WHERE f <> o)
    SELECT CAST(o AS INT) AS outer_fold, id_measurement, CAST((row_number() OVER (PARTITION BY o, s ORDER BY {h(43, 'id_measurement')}, id_measurement) - 1) % 4 AS INT) AS inner_fold FROM fit""",
)
def nested_folds(spark, sf):
    return sp.nested_folds(src.triples(spark, sf), 5, 4, 42, group="id_measurement")
