"""Bootstrap intervals, cross-fitted models, storage and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import fusion as fz
from sigloom.functions.scalars import confidence, logit
from sigloom.operators import meta as me
from sigloom.operators import models as mo
from sigloom.operators import projections as pr
from sigloom.operators import resampling as rs
from sigloom.operators import signals as sg
from sigloom.operators import splits as sp
from sigloom.plans import inputs as src
from sigloom.plans.metric_queries import SQL_MCC
from sigloom.plans.registry import query, rounded
from sigloom.sources import signals as sources
from sigloom.sources import tables as tb
from sigloom.streaming import arrivals as st

# Bootstrap ----------------------------------------------------------------------------

A = {"tp": "(s6+s7)", "tn": "(s0+s1)", "fp": "(s2+s3)", "fn": "(s4+s5)"}
B = {"tp": "(s5+s7)", "tn": "(s0+s2)", "fp": "(s1+s3)", "fn": "(s4+s6)"}
DELTA = f"({SQL_MCC.format(**A)}) - ({SQL_MCC.format(**B)})"
COUNTS8 = ", ".join(f"count(*) FILTER (4*target+2*d_temporal+d_spectral = {k})::DOUBLE AS s{k}" for k in range(8))
SUM8 = ", ".join(f"sum(s{k}) AS s{k}" for k in range(8))
INTERVAL = """round(avg(delta),6) AS bootstrap_mean, round(median(delta),6) AS bootstrap_median, round(quantile_cont(delta,0.025),6) AS ci_low,
  round(quantile_cont(delta,0.975),6) AS ci_high, round(avg(CAST(delta>0 AS INT)),6) AS fraction_gt_zero, count(*) AS iterations"""


def hashed(by: str, key: str, n: int) -> str:
    comma = f"{by}, " if by else ""
    join = f"d.{by}=g.{by} AND " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""g AS (SELECT {comma}id_measurement, row_number() OVER ({part} ORDER BY id_measurement) - 1 AS i, count(*) OVER ({part}) AS gs, {COUNTS8} FROM pair GROUP BY {comma}id_measurement),
     d AS (SELECT {comma}replicate, ('0x' || substr(md5('42|' || {key}replicate || '|' || i),1,8))::BIGINT % gs AS i FROM g, range({n}) r(replicate)),
     s AS (SELECT {'d.' + by + ', ' if by else ''}replicate, {SUM8} FROM d JOIN g ON {join}d.i = g.i GROUP BY ALL),
     rep AS (SELECT {comma}replicate, {DELTA} AS delta FROM s)"""


@query("hashed_group_bootstrap", f"WITH {src.PAIR}, {hashed('', '', 100)} SELECT {INTERVAL} FROM rep")
def hashed_group_bootstrap(spark, sf):
    reps = rs.hashed_group_replicates(src.pair(spark, sf), [], "id_measurement", "target", "d_temporal", "d_spectral", 100)
    return rounded(rs.summarize(reps))


@query(
    "hashed_group_replicates",
    f"WITH {src.PAIR}, {hashed('seed', '''seed || '|' || ''', 40)} SELECT seed, CAST(replicate AS INT) AS replicate, round(delta,6) AS delta FROM rep",
)
def hashed_group_replicates(spark, sf):
    return rounded(rs.hashed_group_replicates(src.pair(spark, sf), ["seed"], "id_measurement", "target", "d_temporal", "d_spectral", 40))


@query(
    "hashed_hierarchical_bootstrap",
    f"""WITH {src.PAIR}, {hashed('seed', '''seed || '|' || ''', 60)}, h AS (SELECT replicate, avg(delta) AS delta FROM rep GROUP BY 1) SELECT {INTERVAL} FROM h""",
)
def hashed_hierarchical_bootstrap(spark, sf):
    reps = rs.hashed_group_replicates(src.pair(spark, sf), ["seed"], "id_measurement", "target", "d_temporal", "d_spectral", 60)
    return rounded(rs.summarize(rs.hierarchical(reps)))


@query(
    "hashed_signal_bootstrap",
    f"WITH {src.PAIR}, {hashed('', '', 20).replace('id_measurement', 'sample_id')} SELECT {INTERVAL} FROM rep",
)
def hashed_signal_bootstrap(spark, sf):
    """Resampling single signals is resampling groups of one."""
    reps = rs.hashed_group_replicates(src.pair(spark, sf), [], "sample_id", "target", "d_temporal", "d_spectral", 20)
    return rounded(rs.summarize(reps))


@query(
    "group_profiles",
    f"""WITH {src.PAIR}, g AS (SELECT id_measurement, {COUNTS8} FROM pair GROUP BY 1)
    SELECT {', '.join(f'CAST(s{k} AS BIGINT) AS s{k}' for k in range(8))}, count(*) AS groups FROM g GROUP BY ALL""",
)
def group_profiles(spark, sf):
    return rs.group_profiles(src.pair(spark, sf), [], "id_measurement", "target", "d_temporal", "d_spectral")


@query("signal_bootstrap")
def signal_bootstrap(spark, sf):
    return rounded(rs.bootstrap_delta(src.pair(spark, sf), ["seed", "split"], "target", "d_temporal", "d_spectral", 10_000))


@query("group_bootstrap")
def group_bootstrap(spark, sf):
    return rounded(rs.bootstrap_delta(src.pair(spark, sf), ["seed"], "target", "d_temporal", "d_spectral", 10_000, group="id_measurement"))


@query("hierarchical_bootstrap")
def hierarchical_bootstrap(spark, sf):
    return rounded(rs.hierarchical_delta_ci(src.pair(spark, sf), "target", "d_temporal", "d_spectral", 10_000))


@query("hierarchical_group_bootstrap")
def hierarchical_group_bootstrap(spark, sf):
    return rounded(rs.hierarchical_delta_ci(src.pair(spark, sf), "target", "d_temporal", "d_spectral", 10_000, group="id_measurement"))


# Models -------------------------------------------------------------------------------


def folded_pair(spark, sf):
    p = src.pair(spark, sf).withColumn("fold", F.pmod("id_measurement", F.lit(5)).cast("int"))
    return p


def sql_logit(p: str) -> str:
    c = f"greatest(least({p}, 1-1e-6), 1e-6)"
    return f"ln({c}/(1-{c}))"


# Newton steps as a recursion: one row per model and step, the small systems solved in closed form.
PLATT_SQL = f"""WITH RECURSIVE {src.PAIR}, z AS (SELECT sample_id, seed, target, {sql_logit('p_temporal')} AS z FROM pair),
it AS (SELECT 0 AS step, seed, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT seed FROM z)
  UNION ALL
  SELECT step+1, seed, a - (hbb*ga-hab*gb)/(haa*hbb-hab*hab), b - (haa*gb-hab*ga)/(haa*hbb-hab*hab) FROM (
    SELECT step, seed, a, b, sum(q-target) AS ga, sum((q-target)*z)+b AS gb, sum(q*(1-q)) AS haa, sum(q*(1-q)*z) AS hab, sum(q*(1-q)*z*z)+1 AS hbb
    FROM (SELECT it.*, z.target, z.z, 1/(1+exp(-(it.a+it.b*z.z))) AS q FROM it JOIN z ON it.seed=z.seed WHERE it.step<15) GROUP BY step, seed, a, b))
SELECT sample_id, z.seed, round(1/(1+exp(-(a+b*z))),6) AS calibrated FROM z JOIN it ON it.seed=z.seed AND it.step=15"""

STACK_SQL = f"""WITH RECURSIVE {src.PAIR}, z AS (SELECT sample_id, CAST(id_measurement % 5 AS INT) AS fold, target, {sql_logit('p_temporal')} AS x, {sql_logit('p_spectral')} AS y FROM pair),
f AS (SELECT DISTINCT fold AS m FROM z),
s AS (SELECT m, count(*) AS n, sum(target) AS p, var_pop(x) AS vx, var_pop(y) AS vy FROM z JOIN f ON fold <> m GROUP BY m),
t AS (SELECT m, target, x, y, vx, vy, CASE WHEN target=1 THEN n/(2.0::DOUBLE*p) ELSE n/(2.0::DOUBLE*(n-p)) END AS w FROM z JOIN s ON fold <> m),
it AS (SELECT 0 AS step, m, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM f
  UNION ALL
  SELECT step+1, m, a - (i11*g1+i12*g2+i13*g3)/d, b - (i12*g1+i22*g2+i23*g3)/d, c - (i13*g1+i23*g2+i33*g3)/d FROM (
    SELECT *, h22*h33-h23*h23 AS i11, h13*h23-h12*h33 AS i12, h12*h23-h13*h22 AS i13, h11*h33-h13*h13 AS i22, h12*h13-h11*h23 AS i23, h11*h22-h12*h12 AS i33,
      h11*(h22*h33-h23*h23) - h12*(h12*h33-h23*h13) + h13*(h12*h23-h22*h13) AS d FROM (
      SELECT step, m, a, b, c, sum(r) AS g1, sum(r*x)+max(vx)*b AS g2, sum(r*y)+max(vy)*c AS g3, sum(k) AS h11, sum(k*x) AS h12, sum(k*y) AS h13,
        sum(k*x*x)+max(vx) AS h22, sum(k*x*y) AS h23, sum(k*y*y)+max(vy) AS h33
      FROM (SELECT *, w*(q-target) AS r, w*q*(1-q) AS k FROM (
        SELECT it.step, it.m, it.a, it.b, it.c, t.target, t.x, t.y, t.vx, t.vy, t.w, 1/(1+exp(-(it.a+it.b*t.x+it.c*t.y))) AS q FROM it JOIN t ON it.m=t.m WHERE it.step<15))
      GROUP BY step, m, a, b, c)))
SELECT sample_id, fold, round(1/(1+exp(-(a+b*x+c*y))),6) AS probability FROM z JOIN it ON it.m=z.fold AND it.step=15"""


@query("platt_calibration", PLATT_SQL)
def platt_calibration(spark, sf):
    p = src.pair(spark, sf)
    models = mo.fit_platt(p, ["seed"], "p_temporal")
    out = mo.apply_platt(p, models, "p_temporal", "calibrated")
    return rounded(out.select("sample_id", "seed", "calibrated"))


@query("reliability_models")
def reliability_models(spark, sf):
    """Cross-fitted correctness models of one expert, base and extended inputs, with their quality."""
    p = folded_pair(spark, sf).withColumn("ok", (F.col("d_temporal") == F.col("target")).cast("int"))
    base = fz.reliability_features("p_temporal", "p_spectral")
    extra = {"phase_number": F.col("phase").cast("double")}
    qualities = []
    for name, cols in (("base", base), ("extended", base | extra)):
        rows = p.select("sample_id", "seed", "fold", "ok", *[c.alias(n) for n, c in cols.items()])
        scored = mo.stacking(rows, list(cols), target="ok")
        quality = mo.reliability_quality(scored, ["seed"], "probability", "ok")
        qualities.append(quality.withColumns({"inputs": F.lit(name), "extended": F.lit(int(name == "extended"))}))
    chosen = mo.select_reliability(pr.union_results(*qualities), ["seed"])
    return rounded(chosen.select("seed", "inputs", "brier", "roc_auc"))


@query("stacking", STACK_SQL)
def stacking(spark, sf):
    p = folded_pair(spark, sf).withColumns({"z_temporal": logit("p_temporal"), "z_spectral": logit("p_spectral")})
    return rounded(mo.stacking(p, ["z_temporal", "z_spectral"]).select("sample_id", "fold", "probability"))


@query("disagreement_gate")
def disagreement_gate(spark, sf):
    p = src.pair(spark, sf)
    _, _, tau = mo.disagreement_gate(
        p.where("split = 'train_oof'"), p.where("split = 'validation'"), "p_temporal", "p_spectral", 0.45, 0.5, ["seed"]
    )
    return rounded(tau)


@query("meta_fusion")
def meta_fusion(spark, sf):
    """Every fused method, cross-fitted on OOF rows and applied to validation, with its metrics."""
    from sigloom.operators.metrics import binary_metrics

    p = src.pair(spark, sf)
    oof = sp.grouped_folds(p.where("split = 'train_oof'"), 5, 10042)
    long, _ = me.meta_fusion(oof, p.where("split = 'validation'"), by=["seed"])
    return rounded(binary_metrics(long, ["seed", "split", "method"]))


# Calibration by Newton steps for every (seed, model, expert), then counts by cell of the threshold
# grid for the experts, their mean and every weight; model m never sees fold m, model -1 sees all.
COMPONENTS_SQL = f"""WITH RECURSIVE {src.PAIR},
o AS (SELECT sample_id, seed, target, CAST(id_measurement % 5 AS INT) AS fold, p_temporal, p_spectral FROM pair WHERE split = 'train_oof'),
x AS (SELECT sample_id, seed, fold, target, 0 AS e, {sql_logit('p_temporal')} AS z FROM o UNION ALL SELECT sample_id, seed, fold, target, 1, {sql_logit('p_spectral')} FROM o),
t AS MATERIALIZED (SELECT x.*, m FROM x, range(-1, 5) r(m) WHERE fold <> m),
it AS (SELECT 0 AS step, seed, m, e, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT seed, m, e FROM t)
  UNION ALL
  SELECT step+1, seed, m, e, a - (hbb*ga-hab*gb)/(haa*hbb-hab*hab), b - (haa*gb-hab*ga)/(haa*hbb-hab*hab) FROM (
    SELECT step, seed, m, e, a, b, sum(q-target) AS ga, sum((q-target)*z)+b AS gb, sum(q*(1-q)) AS haa, sum(q*(1-q)*z) AS hab, sum(q*(1-q)*z*z)+1 AS hbb
    FROM (SELECT it.*, t.target, t.z, 1/(1+exp(-(it.a+it.b*t.z))) AS q FROM it JOIN t ON it.seed=t.seed AND it.m=t.m AND it.e=t.e WHERE it.step<12) GROUP BY step, seed, m, e, a, b)),
c AS (SELECT t.seed, t.m, t.sample_id, any_value(t.target) AS y, max(1/(1+exp(-(a+b*z)))) FILTER (t.e=0) AS p, max(1/(1+exp(-(a+b*z)))) FILTER (t.e=1) AS q
  FROM t JOIN it ON it.seed=t.seed AND it.m=t.m AND it.e=t.e AND it.step=12 GROUP BY t.seed, t.m, t.sample_id),
v AS (SELECT seed, m, y, w, CASE WHEN w = -1 THEN p WHEN w = -2 THEN q WHEN w = -3 THEN (p+q)/2 ELSE (w/20.0::DOUBLE)*p + (1-w/20.0::DOUBLE)*q END AS r FROM c, range(-3, 21) s(w)),
k AS (SELECT seed, m, w, y, greatest(least(CASE WHEN r < f/200.0::DOUBLE THEN f-1 WHEN r >= (f+1)/200.0::DOUBLE THEN f+1 ELSE f END, 190), 9) AS cell FROM (SELECT *, floor(r*200) AS f FROM v)),
h AS (SELECT seed, m, w, cell, count(*) FILTER (y=1) AS p, count(*) FILTER (y=0) AS n FROM k GROUP BY ALL),
g AS (SELECT h.seed, h.m, h.w, s.k, coalesce(sum(p) FILTER (cell >= s.k), 0) AS tp, coalesce(sum(n) FILTER (cell >= s.k), 0) AS fp, sum(p) AS pp, sum(n) AS nn FROM h, range(10, 191) s(k) GROUP BY ALL),
d AS (SELECT seed, m, w, k, tp::DOUBLE AS tp, fp::DOUBLE AS fp, (nn-fp)::DOUBLE AS tn, (pp-tp)::DOUBLE AS fn FROM g),
u AS (SELECT seed, m, w, k, coalesce((tp*tn-fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),0), 0) AS mcc FROM d),
b1 AS (SELECT seed, m, w, k, mcc FROM (SELECT *, max(mcc) OVER (PARTITION BY seed, m, w) AS top FROM u) WHERE abs(mcc-top) <= 1e-8 + 1e-5*abs(top) QUALIFY row_number() OVER (PARTITION BY seed, m, w ORDER BY abs(k-100), k) = 1),
bw AS (SELECT * FROM b1 WHERE w >= 0 QUALIFY row_number() OVER (PARTITION BY seed, m ORDER BY mcc DESC, abs(2*w-20), w) = 1)
SELECT a.seed, CAST(a.m AS INT) AS model, a.k/200.0::DOUBLE AS temporal_cut, s.k/200.0::DOUBLE AS spectral_cut, f.k/200.0::DOUBLE AS fixed_50_cut, round(a.mcc,6) AS temporal_mcc, round(s.mcc,6) AS spectral_mcc,
  CASE WHEN a.mcc >= s.mcc THEN 'temporal' ELSE 'spectral' END AS best_individual, bw.w/20.0::DOUBLE AS weight, bw.k/200.0::DOUBLE AS best_fixed_cut
FROM b1 a JOIN b1 s ON s.seed=a.seed AND s.m=a.m AND s.w=-2 JOIN b1 f ON f.seed=a.seed AND f.m=a.m AND f.w=-3 JOIN bw ON bw.seed=a.seed AND bw.m=a.m WHERE a.w=-1"""


@query("meta_fusion_components", COMPONENTS_SQL)
def meta_fusion_components(spark, sf):
    """The cut-offs and weights of every seed and model of a meta fusion."""
    _, components = me.meta_fusion(folded_pair(spark, sf).where("split = 'train_oof'"), None, by=["seed"])
    keep = ("temporal_cut", "spectral_cut", "fixed_50_cut", "temporal_mcc", "spectral_mcc", "best_individual", "weight", "best_fixed_cut")
    return rounded(components.select("seed", "model", *keep))


def features(spark, sf):
    """Block means and stds of each signal, named so that families can be told apart."""
    s = src.signals(spark, sf)
    e = sg.block_embedding(s, 4)
    names = ["current_candidate_count", "current_selected_count", "current_score_median", "current_score_p90",
             "cwt_energy_low", "cwt_energy_mid", "cwt_energy_high", "cwt_entropy"]
    return e.select(
        "sample_id", "id_measurement", "phase", "target", "split",
        *[F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate(names)],
    ), names


@query("cross_fit")
def cross_fit(spark, sf):
    df, names = features(spark, sf)
    folded = sp.grouped_folds(df, 5, 42)
    out = mo.cross_fit(folded, names, "logistic", fold_transform=mo.impute_transform(names))
    return rounded(out.select("sample_id", "fold", "probability"))


@query("feature_baseline")
def feature_baseline(spark, sf):
    df, names = features(spark, sf)
    _, metrics = mo.feature_baseline(df, names)
    return rounded(metrics)


@query("measurement_aware_baseline")
def measurement_aware_baseline(spark, sf):
    from sigloom.operators.audits import complete_groups
    from sigloom.operators.joins import keep_groups

    df, names = features(spark, sf)
    group_split = F.when(F.col("id_measurement") % 4 == 0, "validation").otherwise("train")
    whole = keep_groups(df, complete_groups(df)).withColumn("split", group_split)
    rows = []
    for mode in ("measurement_aware", "measurement_any_positive"):
        _, metrics = mo.feature_baseline(whole, names, mode=mode)
        rows.append(metrics)
    return rounded(pr.union_results(*rows))


@query("domain_shift")
def domain_shift(spark, sf):
    df, names = features(spark, sf)
    return rounded(mo.domain_shift(df, names))


@query("morphology")
def morphology(spark, sf):
    s = src.signals(spark, sf)
    return mo.morphology(s, ["sample_id"], "values", 64, components=10, clusters=12)


@query(
    "full_reliability_features",
    f"""WITH {src.SIGNALS}, c AS (SELECT target, i, avg(v) AS m FROM samples WHERE split='train' GROUP BY ALL),
      d AS (SELECT s.sample_id, max(dd) FILTER (ct=0) AS d0, max(dd) FILTER (ct=1) AS d1 FROM (SELECT s.sample_id, c.target AS ct, sqrt(sum((v-m)*(v-m))) AS dd FROM samples s JOIN c ON s.i=c.i GROUP BY ALL) s GROUP BY 1),
      p AS (SELECT sample_id, 1/(1+exp(-(d1-d0)*20)) AS a, 1/(1+exp(-(d1-d0)*5)) AS b, d0, d1 FROM d),
      q AS (SELECT *, least(greatest(a,1e-7),1-1e-7) AS ca, least(greatest(b,1e-7),1-1e-7) AS cb FROM p)
    SELECT sample_id, round((d1-d0)*20,6) AS logit_a, round((d1-d0)*5,6) AS logit_b, round(a,6) AS probability_a, round(b,6) AS probability_b, round(abs(a-0.5),6) AS margin_a, round(abs(b-0.5),6) AS margin_b,
      round(-(ca*log2(ca)+(1-ca)*log2(1-ca)),6) AS entropy_a, round(-(cb*log2(cb)+(1-cb)*log2(1-cb)),6) AS entropy_b, round(greatest(a,1-a),6) AS confidence_a, round(greatest(b,1-b),6) AS confidence_b,
      round(abs(a-b),6) AS absolute_difference, round(a-b,6) AS signed_difference, CAST((a>=0.5)=(b>=0.5) AS INT)::DOUBLE AS agreement, round(d0,6) AS distance_a_class0, round(d1,6) AS distance_a_class1,
      round(d0,6) AS distance_b_class0, round(d1,6) AS distance_b_class1, round(d0-d1,6) AS centroid_margin_a, round(d0-d1,6) AS centroid_margin_b FROM q""",
)
def full_reliability_features(spark, sf):
    s = src.signals(spark, sf)
    d = sg.centroid_distance(s, sg.fit_centroids(s.where("split = 'train'"), "values"), "values")
    gap = F.col("distance_1") - F.col("distance_0")
    rows = d.select("sample_id", "distance_0", "distance_1", (gap * 20).alias("la"), (gap * 5).alias("lb"))
    rows = rows.withColumns({"a": 1 / (1 + F.exp(-F.col("la"))), "b": 1 / (1 + F.exp(-F.col("lb")))})
    cols = fz.full_reliability_features("la", "lb", "a", "b", distances=("distance_0", "distance_1", "distance_0", "distance_1"))
    return rounded(rows.select("sample_id", *[c.alias(n) for n, c in cols.items()]))


@query(
    "adaptive_weights",
    f"""WITH {src.PAIR}, r AS (SELECT sample_id, greatest(p_temporal,1-p_temporal) AS a, greatest(p_spectral,1-p_spectral) AS b FROM pair)
    SELECT sample_id, round(a/(a+b+1e-8),9) AS weight_a, round(b/(a+b+1e-8),9) AS weight_b FROM r""",
)
def adaptive_weights(spark, sf):
    wa, wb = fz.adaptive_weights(confidence("p_temporal"), confidence("p_spectral"))
    return rounded(src.pair(spark, sf).select("sample_id", wa.alias("weight_a"), wb.alias("weight_b")), 9)


# Storage ------------------------------------------------------------------------------

WIDE = f"""WITH {src.PAIR} SELECT sample_id, target AS label, 'wide' AS dataset_id, split, seed, 'v1' AS config_version, p_temporal AS probability_temporal, p_spectral AS probability_spectral FROM pair"""


def wide_frame(spark, sf):
    p = src.pair(spark, sf)
    base = p.select("sample_id", F.col("target").alias("label"), "split", "seed")
    scores = {m: p.select("sample_id", F.col(f"p_{m}").alias("probability")) for m in src.METHODS}
    return tb.prediction_frame(base, scores, "wide", "v1")


@query("prediction_frame", WIDE)
def prediction_frame(spark, sf):
    return wide_frame(spark, sf)


@query("write_predictions", WIDE)
def write_predictions(spark, sf):
    path = st.work_path(spark, "predictions")
    tb.write_predictions(wide_frame(spark, sf), path)
    return spark.read.parquet(path).withColumn("seed", F.col("seed").cast("int"))


@query(
    "write_table",
    """SELECT fmt, o_orderkey, o_orderstatus, o_totalprice FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)""",
)
def write_table(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root = st.work_path(spark, "formats")
    parts = []
    for fmt in ("csv", "json", "parquet"):
        tb.write_table(o, f"{root}/{fmt}", fmt)
        back = tb.read_table(spark, f"{root}/{fmt}", fmt, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    return pr.union_results(*parts)


@query("read_metadata", f"WITH {src.TRIPLES} SELECT CAST(sample_id AS VARCHAR) AS signal_id, CAST(id_measurement AS VARCHAR) AS id_measurement, phase, target FROM triples")
def read_metadata(spark, sf):
    path = st.work_path(spark, "metadata")
    t = src.triples(spark, sf).select(F.col("sample_id").alias("signal_id"), "id_measurement", "phase", "target")
    tb.write_table(t, path, "csv")
    return sources.read_metadata(spark, path)


@query(
    "stored_representation",
    f"""WITH {src.SIGNALS} SELECT sample_id, i // 4 AS block, round(avg(v),6) AS mean FROM samples GROUP BY ALL""",
)
def stored_representation(spark, sf):
    """Write block means once under their parameters, then read them back by the same parameters."""
    root, params = st.work_path(spark, "representation"), {"kind": "block_mean", "blocks": 16}
    e = sg.block_embedding(src.signals(spark, sf).select("sample_id", "values"), 16).select("sample_id", F.slice("embedding", 1, 16).alias("embedding"))
    tb.save_representation(e, root, params)
    back = tb.load_representation(spark, root, params)
    return rounded(back.select("sample_id", F.posexplode("embedding").alias("block", "mean")).withColumn("block", F.col("block").cast("bigint")))


@query(
    "table_fingerprint",
    f"""WITH d AS (SELECT sha256({' || '.join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))}) AS d FROM orders),
      w AS (SELECT {', '.join(f"('0x' || substr(d, {16 * k + 1}, 15))::BIGINT AS w{k}" for k in range(4))} FROM d)
    SELECT count(*) AS rows, {', '.join(f"bit_xor(w{k}) AS xor_{k}, CAST(sum(w{k} % 1000000007) AS BIGINT) AS sum_{k}" for k in range(4))} FROM w""",
)
def table_fingerprint(spark, sf):
    return tb.table_fingerprint(src.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("file_inventory")
def file_inventory(spark, sf):
    return tb.file_inventory(spark, f"{sf}/*.parquet", ["orders.parquet", "events.parquet", "absent.parquet"])


# Streaming ----------------------------------------------------------------------------


@query(
    "stream_moments",
    f"""WITH {src.SIGNALS} SELECT CAST(i AS INT) AS pos, count(*) AS n, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std FROM samples GROUP BY i""",
)
def stream_moments(spark, sf):
    arriving = st.arriving(spark, f"{sf}/embeddings.parquet*")
    return rounded(st.stream_moments(arriving, "embedding", 64))


@query(
    "store_stream",
    f"""WITH {src.SIGNALS}, st AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s FROM (SELECT DISTINCT least(k*10, 48) AS s FROM range(6) r(k)))
    SELECT sample_id, CAST(w AS INT) AS window_index, round(sum(v),6) AS total FROM samples JOIN st ON i >= s AND i < s + 16 GROUP BY ALL""",
)
def store_stream(spark, sf):
    """Arriving signals cut into windows and stored; every signal must be there once."""
    from sigloom.functions.arrays import array_sum

    def cut(stream):
        named = stream.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"))
        return sg.windows(named, sg.WindowSpec(16, 10)).select("sample_id", "window_index", array_sum("values").alias("total"))

    expected = src.table(spark, sf, "embeddings").count()
    return rounded(st.store_stream(st.arriving(spark, f"{sf}/embeddings.parquet*"), cut, expected, ["sample_id"], rows_per_key=6))
