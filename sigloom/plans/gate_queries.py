"""Contracts, gates and verdicts over metric tables computed from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import gates as g
from sigloom.plans import inputs as src
from sigloom.plans.registry import query, rounded

# Development records: one row per (candidate, seed), scores spread around the gate limits.
RECORDS = """
records AS (SELECT l_suppkey % 25 AS candidate, CAST(42 + l_orderkey % 3 AS INT) AS seed,
    round(0.68 + (avg(l_quantity) - 25.5) * 0.04, 4) AS temporal_validation_mcc,
    round(0.66 + (avg(l_tax) - 0.04) * 20, 4) AS cwt_validation_mcc,
    CAST(l_suppkey % 25 % 4 AS DOUBLE) AS compute_cost
  FROM lineitem GROUP BY ALL),
best AS (SELECT *, greatest(temporal_validation_mcc, cwt_validation_mcc) AS b, least(temporal_validation_mcc, cwt_validation_mcc) AS s FROM records)
"""


def records(spark, sf):
    l = src.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_tax")
    return l.groupBy(
        (F.col("l_suppkey") % 25).alias("candidate"), (F.lit(42) + F.col("l_orderkey") % 3).cast("int").alias("seed")
    ).agg(
        F.round(F.lit(0.68) + (F.avg("l_quantity") - 25.5) * 0.04, 4).alias("temporal_validation_mcc"),
        F.round(F.lit(0.66) + (F.avg("l_tax") - 0.04) * 20, 4).alias("cwt_validation_mcc"),
    ).withColumns(
        {
            "compute_cost": (F.col("candidate") % 4).cast("double"),
            "best_individual_mcc": F.greatest("temporal_validation_mcc", "cwt_validation_mcc"),
            "minimum_expert_mcc": F.least("temporal_validation_mcc", "cwt_validation_mcc"),
        }
    )


SINGLE = """single AS (SELECT candidate, avg(b) AS mean_best, min(b) AS minimum_best, min(s) AS minimum_expert, max(compute_cost) AS compute_cost FROM best GROUP BY candidate),
  single_d AS (SELECT *, CASE WHEN mean_best <= 0.6 THEN 'STOP' WHEN mean_best < 0.7 OR minimum_best <= 0.6 THEN 'WEAK_DO_NOT_FREEZE' ELSE 'PASS' END AS status FROM single)"""
DOUBLE = """double AS (SELECT candidate, avg(b) AS mean_best, avg(s) AS mean_second, min(b) AS minimum_best, min(s) AS minimum_second, max(compute_cost) AS compute_cost FROM best GROUP BY candidate),
  double_d AS (SELECT *, CASE WHEN minimum_best <= 0.6 OR mean_best < 0.6 OR mean_second < 0.6 THEN 'STOP'
     WHEN mean_best < 0.7 OR mean_second < 0.65 THEN 'REVIEW_DO_NOT_FREEZE' ELSE 'PASS' END AS status FROM double)"""


@query(
    "single_score_gate",
    f"""WITH {RECORDS}, {SINGLE} SELECT candidate, round(mean_best,6) AS mean_best, round(minimum_best,6) AS minimum_best,
     round(minimum_expert,6) AS minimum_expert, compute_cost, status FROM single_d""",
)
def single_score_gate(spark, sf):
    return rounded(g.single_score_gate(records(spark, sf)))


@query(
    "two_score_gate",
    f"""WITH {RECORDS}, {DOUBLE} SELECT candidate, round(mean_best,6) AS mean_best, round(mean_second,6) AS mean_second, round(minimum_best,6) AS minimum_best,
     round(minimum_second,6) AS minimum_second, compute_cost, status FROM double_d""",
)
def two_score_gate(spark, sf):
    return rounded(g.two_score_gate(records(spark, sf)))


@query(
    "select_candidate",
    f"""WITH {RECORDS}, {DOUBLE} SELECT candidate, round(mean_best,6) AS mean_best, round(mean_second,6) AS mean_second, compute_cost FROM double_d
     WHERE status = 'PASS' ORDER BY double_d.mean_best DESC, double_d.mean_second DESC, compute_cost, candidate LIMIT 1""",
)
def select_candidate(spark, sf):
    picked = g.select_candidate(g.two_score_gate(records(spark, sf)), "mean_second")
    return rounded(picked.select("candidate", "mean_best", "mean_second", "compute_cost"))


@query(
    "select_near_best",
    f"""WITH {RECORDS}, m AS (SELECT candidate, avg((b+s)/2) AS mean_mcc, min(s) AS minimum_expert_mcc, max(compute_cost) AS compute_cost FROM best GROUP BY candidate)
    SELECT candidate, round(mean_mcc,6) AS mean_mcc, round(minimum_expert_mcc,6) AS minimum_expert_mcc, compute_cost FROM m
    WHERE mean_mcc >= (SELECT max(mean_mcc) FROM m) - 0.02 ORDER BY m.minimum_expert_mcc DESC, compute_cost, candidate LIMIT 1""",
)
def select_near_best(spark, sf):
    rows = records(spark, sf).groupBy("candidate").agg(
        F.avg((F.col("best_individual_mcc") + F.col("minimum_expert_mcc")) / 2).alias("mean_mcc"),
        F.min("minimum_expert_mcc").alias("minimum_expert_mcc"),
        F.max("compute_cost").alias("compute_cost"),
    )
    return rounded(g.select_near_best(rows, 0.02))


@query(
    "missing_candidates",
    f"""WITH {RECORDS} SELECT c AS candidate, s AS seed FROM (SELECT CAST(c AS BIGINT) AS c FROM range(30) r(c)), (SELECT CAST(s AS INT) AS s FROM range(42,46) q(s))
    WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.candidate = c AND r.seed = s)""",
)
def missing_candidates(spark, sf):
    return g.missing_candidates(records(spark, sf), range(30), range(42, 46))


METHODS = """methods AS (SELECT candidate, seed, 'temporal' AS method, temporal_validation_mcc AS mcc FROM records
  UNION ALL SELECT candidate, seed, 'cwt', cwt_validation_mcc FROM records)"""


@query(
    "expert_gate",
    f"""WITH {RECORDS}, {METHODS}, p AS (SELECT candidate, method, avg(mcc) AS m, min(mcc) AS lo, count(*) AS n FROM methods GROUP BY ALL)
    SELECT candidate, count(*) AS methods, round(min(m),6) AS weakest_mean_mcc, round(min(lo),6) AS weakest_seed_mcc,
      count(*) FILTER (n=3 AND m>=0.655 AND lo>=0.62) = 2 AS eligible FROM p GROUP BY candidate""",
)
def expert_gate(spark, sf):
    long = records(spark, sf).select(
        "candidate", "seed", F.col("temporal_validation_mcc").alias("temporal"), F.col("cwt_validation_mcc").alias("cwt")
    ).unpivot(["candidate", "seed"], ["temporal", "cwt"], "method", "mcc")
    return rounded(g.expert_gate(long, ["candidate"], ["temporal", "cwt"], 0.655, 0.62))


DELTAS = """deltas AS (SELECT candidate, 'cwt_minus_temporal' AS comparison, seed, cwt_validation_mcc - temporal_validation_mcc AS delta, 0.02 - compute_cost/100 AS ci_low FROM records
  UNION ALL SELECT candidate, 'best_minus_temporal', seed, b - temporal_validation_mcc, compute_cost/100 - 0.01 FROM best)"""


def deltas(spark, sf):
    r = records(spark, sf)
    item = F.explode(
        F.array(
            F.struct(
                F.lit("cwt_minus_temporal").alias("comparison"),
                (F.col("cwt_validation_mcc") - F.col("temporal_validation_mcc")).alias("delta"),
                (F.lit(0.02) - F.col("compute_cost") / 100).alias("ci_low"),
            ),
            F.struct(
                F.lit("best_minus_temporal").alias("comparison"),
                (F.col("best_individual_mcc") - F.col("temporal_validation_mcc")).alias("delta"),
                (F.col("compute_cost") / 100 - 0.01).alias("ci_low"),
            ),
        )
    )
    return r.select("candidate", "seed", item.alias("d")).select("candidate", "seed", "d.*")


FGATE = f"""WITH {RECORDS}, {DELTAS}, p AS (SELECT candidate, comparison, avg(delta) AS d, count(*) FILTER (delta>0) AS pos, max(ci_low) AS ci FROM deltas GROUP BY ALL),
  q AS (SELECT *, d>=0.005 AND pos>=2 AND ci>0 AS passed FROM p)"""


@query(
    "fusion_gate",
    f"""{FGATE} SELECT candidate, comparison, round(d,6) AS mean_delta, pos AS positive_seeds, round(ci,6) AS ci_low, passed FROM q""",
)
def fusion_gate(spark, sf):
    return rounded(g.fusion_gate(deltas(spark, sf), by=["candidate"]))


@query("fusion_eligible", f"{FGATE} SELECT candidate, bool_or(passed) AS eligible FROM q GROUP BY candidate")
def fusion_eligible(spark, sf):
    return g.fusion_eligible(g.fusion_gate(deltas(spark, sf), by=["candidate"]), ["candidate"])


@query(
    "source_contract",
    f"""WITH {src.PREDICTIONS} SELECT count(*) AS rows, count(DISTINCT sample_id) AS parent_rows, count(DISTINCT seed) AS seeds, 0::BIGINT AS duplicates,
      0::BIGINT AS incomplete_pairs, 0::BIGINT AS inconsistent_labels, 0::BIGINT AS unexpected_method, 0::BIGINT AS holdout_rows, 0::BIGINT AS unsupported_split,
      0::BIGINT AS unexpected_seed, 0::BIGINT AS non_finite, 0::BIGINT AS out_of_range, 0::BIGINT AS bad_target, 'PASS' AS status FROM predictions""",
)
def source_contract(spark, sf):
    return g.source_contract(src.predictions(spark, sf), src.METHODS, [42, 43, 44])


@query(
    "source_contract_violations",
    """WITH p AS (SELECT event_id // 2 AS sample_id, CASE WHEN event_type='view' THEN 'temporal' ELSE 'spectral' END AS method, value/400 AS probability, CAST(event_type='error' AS INT) AS target,
        CASE WHEN event_id % 50 = 0 THEN 'test' ELSE 'validation' END AS split FROM events),
      m AS (SELECT split, sample_id, method, count(*) AS n, min(target) AS lo, max(target) AS hi FROM p GROUP BY ALL),
      s AS (SELECT split, sample_id, count(*) FILTER (n>1) AS rep, count(*) AS k, min(lo)<>max(hi) AS df FROM m GROUP BY ALL)
    SELECT (SELECT count(*) FROM p) AS rows, count(*) AS parent_rows, 1::BIGINT AS seeds, CAST(sum(rep) AS BIGINT) AS duplicates, count(*) FILTER (k<>2) AS incomplete_pairs,
      count(*) FILTER (df) AS inconsistent_labels, 0::BIGINT AS unexpected_method, (SELECT count(*) FROM p WHERE split='test') AS holdout_rows,
      (SELECT count(*) FROM p WHERE split='test') AS unsupported_split, 0::BIGINT AS unexpected_seed, 0::BIGINT AS non_finite,
      (SELECT count(*) FROM p WHERE probability NOT BETWEEN 0 AND 1) AS out_of_range, 0::BIGINT AS bad_target, 'FAIL' AS status FROM s""",
)
def source_contract_violations(spark, sf):
    e = src.table(spark, sf, "events")
    p = e.select(
        F.floor(F.col("event_id") / 2).cast("bigint").alias("sample_id"),
        F.col("user_id").alias("id_measurement"),
        F.lit("0").alias("phase"),
        (F.col("event_type") == "error").cast("int").alias("target"),
        F.lit("wide").alias("dataset"),
        F.when(F.col("event_id") % 50 == 0, "test").otherwise("validation").alias("split"),
        F.when(F.col("event_type") == "view", "temporal").otherwise("spectral").alias("method"),
        F.lit(42).alias("seed"),
        (F.col("value") / 400).alias("probability"),
        F.lit(0.5).alias("threshold"),
        F.lit(0).alias("prediction"),
    )
    return g.source_contract(p, src.METHODS, [42])


@query(
    "verify_stored",
    f"""WITH {src.PAIR}, s AS (SELECT seed, sample_id, CASE WHEN seed=43 AND sample_id % 100 = 0 THEN 1-target ELSE target END AS y, p_temporal AS p FROM pair WHERE NOT (seed=44 AND sample_id % 50 = 0)),
      j AS (SELECT m.seed, m.target, s.y, s.p, s.sample_id IS NULL AS miss FROM pair m LEFT JOIN s USING (sample_id)),
      c AS (SELECT seed, count(*) FILTER (miss) AS missing, 0::BIGINT AS unexpected, count(*) FILTER (y<>target) AS label_mismatch, 0::BIGINT AS bad_probability, 0::BIGINT AS repeated,
        count(*) FILTER (target=0 AND p<0.45) AS tn, count(*) FILTER (target=0 AND p>=0.45) AS fp, count(*) FILTER (target=1 AND p<0.45) AS fn, count(*) FILTER (target=1 AND p>=0.45) AS tp FROM j GROUP BY seed)
    SELECT *, missing=0 AND label_mismatch=0 AS reusable, CASE WHEN missing=0 AND label_mismatch=0 THEN
      round((tp::DOUBLE*tn-fp::DOUBLE*fn)/(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)),6) END AS mcc FROM c""",
)
def verify_stored(spark, sf):
    p = src.pair(spark, sf)
    flip = (F.col("seed") == 43) & (F.col("sample_id") % 100 == 0)
    stored = p.where("NOT (seed = 44 AND sample_id % 50 = 0)").select(
        "seed", "sample_id", F.when(flip, 1 - F.col("target")).otherwise(F.col("target")).alias("target"),
        F.col("p_temporal").alias("probability"), F.lit(0.45).alias("threshold"),
    )
    return rounded(g.verify_stored(stored, p.select("seed", "sample_id", "target"), ["seed"]))


SUMMARY = """summary AS (SELECT candidate, avg(temporal_validation_mcc) - 0.06 AS temporal, avg(cwt_validation_mcc) - 0.10 AS cwt, avg(b) - 0.03 AS combined,
   avg(cwt_validation_mcc - temporal_validation_mcc)/4 AS delta_c_given_t, count(*) FILTER (cwt_validation_mcc > temporal_validation_mcc) AS positive_seeds,
   count(*) FILTER (cwt_validation_mcc < temporal_validation_mcc) AS negative_seeds, candidate % 5 <> 4 AS checks_ok FROM best GROUP BY candidate)"""


def summary(spark, sf):
    t, c = F.col("temporal_validation_mcc"), F.col("cwt_validation_mcc")
    return records(spark, sf).groupBy("candidate").agg(
        (F.avg(t) - 0.06).alias("temporal"),
        (F.avg(c) - 0.10).alias("cwt"),
        (F.avg("best_individual_mcc") - 0.03).alias("combined"),
        (F.avg(c - t) / 4).alias("delta_c_given_t"),
        F.count_if(c > t).alias("positive_seeds"),
        F.count_if(c < t).alias("negative_seeds"),
    ).withColumn("checks_ok", F.col("candidate") % 5 != 4)


@query(
    "modality_verdict",
    f"""WITH {RECORDS}, {SUMMARY}, f AS (SELECT *, delta_c_given_t>=0.01 AND positive_seeds>=2 AND negative_seeds=0 AS strongly,
       delta_c_given_t>=0.005 AND delta_c_given_t<0.01 AND positive_seeds>=2 AS weakly, abs(delta_c_given_t)<0.005 OR positive_seeds<2 AS redundant,
       delta_c_given_t<=-0.005 AND negative_seeds>=2 AS harmful FROM summary)
    SELECT candidate, CASE WHEN NOT checks_ok THEN 'REPRESENTATION DECOMPOSITION INCONCLUSIVE'
       WHEN temporal>=0.6 AND cwt>=0.6 AND combined>greatest(temporal,cwt) AND strongly THEN 'TEMPORAL+CWT SUPPORTED'
       WHEN temporal>=0.6 AND cwt>=0.5 AND (strongly OR weakly) THEN 'CWT COMPLEMENTARY BUT WEAKER'
       WHEN temporal>=0.5 AND cwt>=0.5 AND redundant THEN 'CWT REDUNDANT'
       WHEN (cwt<0.5 OR harmful OR NOT positive_seeds>=2) AND delta_c_given_t<=0.005 THEN 'CWT NOT SUPPORTED'
       WHEN temporal<0.5 AND cwt>=0.6 THEN 'TEMPORAL NOT SUPPORTED' ELSE 'REPRESENTATION DECOMPOSITION INCONCLUSIVE' END AS verdict,
     CASE WHEN temporal>=0.6 THEN 'STRONG' WHEN temporal>=0.5 THEN 'MEANINGFUL BUT WEAKER' WHEN temporal>=0.4 THEN 'WEAK' ELSE 'VERY WEAK' END AS temporal_status,
     CASE WHEN harmful THEN 'HARMFUL' WHEN strongly THEN 'STRONGLY COMPLEMENTARY' WHEN delta_c_given_t>=0.005 AND positive_seeds>=2 THEN 'WEAKLY COMPLEMENTARY'
       WHEN redundant THEN 'REDUNDANT / INCONSISTENT' ELSE 'NOT SUPPORTED' END AS conditional_status FROM f""",
)
def modality_verdict(spark, sf):
    return summary(spark, sf).select(
        "candidate",
        g.modality_verdict().alias("verdict"),
        g.strength_label("temporal").alias("temporal_status"),
        g.conditional_label("delta_c_given_t", "positive_seeds", "negative_seeds").alias("conditional_status"),
    )


@query(
    "cross_dataset_verdicts",
    f"""WITH {RECORDS}, {SUMMARY}, f AS (SELECT candidate, checks_ok AS ok, temporal>=0.62 AS s1, cwt>=0.56 AS s2, delta_c_given_t>0 AS c, 6 - candidate%2 AS pairs FROM summary)
    SELECT candidate, CASE WHEN NOT ok THEN 'INCONCLUSIVE' WHEN s1 AND s2 AND c THEN 'TEMPORAL+SPECTROGRAM SUPPORTED' WHEN s1 AND NOT s2 THEN 'SPECTROGRAM SUPPORTED ONLY ON WIDE'
      WHEN s2 AND NOT s1 THEN 'SPECTROGRAM SUPPORTED ONLY ON ARRAY' WHEN (s1 OR s2) AND NOT c THEN 'SPECTROGRAM NOT COMPLEMENTARY' ELSE 'SPECTROGRAM NOT SUPPORTED' END AS event_verdict,
     CASE WHEN NOT ok THEN 'INCONCLUSIVE' WHEN s1 AND s2 AND c THEN 'TEMPORAL+GLOBAL-SPECTROGRAM SUPPORTED' WHEN s2 AND NOT s1 THEN 'GLOBAL-SPECTROGRAM SUPPORTED ONLY ON ARRAY'
      WHEN s1 AND NOT s2 THEN 'GLOBAL-SPECTROGRAM PROMISING BUT WEAKER' WHEN NOT c THEN 'GLOBAL-SPECTROGRAM NOT COMPLEMENTARY' ELSE 'GLOBAL-SPECTROGRAM NOT SUPPORTED' END AS full_verdict,
     pairs=6 AND c AS complementarity_ok FROM f""",
)
def cross_dataset_verdicts(spark, sf):
    rows = summary(spark, sf).select(
        "candidate",
        F.col("checks_ok").alias("ok"),
        (F.col("temporal") >= 0.62).alias("wide_strong"),
        (F.col("cwt") >= 0.56).alias("array_strong"),
        (F.col("delta_c_given_t") > 0).alias("complementary"),
        (F.lit(6) - F.col("candidate") % 2).alias("pairs"),
        F.lit(0.02).alias("mean_headroom"),
        F.lit(5).alias("seeds_reached"),
        F.col("delta_c_given_t").alias("lowest_ci"),
    )
    return rows.select(
        "candidate",
        g.cross_dataset_verdict("wide", "array").alias("event_verdict"),
        g.full_signal_verdict("wide", "array").alias("full_verdict"),
        g.complementarity_supported().alias("complementarity_ok"),
    )


@query(
    "study_verdicts",
    f"""WITH {RECORDS}, {SUMMARY}, f AS (SELECT *, delta_c_given_t AS d, delta_c_given_t - 0.002 AS ci FROM summary)
    SELECT candidate, CASE WHEN CASE WHEN combined < 0.98 THEN d>=0.005 AND ci>0 ELSE d>0 AND ci>0 AND d>=0.1 END THEN 'GO' WHEN abs(d)<0.01 AND temporal<0.62 THEN 'NO-GO' ELSE 'REVISE' END AS conservative,
      CASE WHEN ci>0 AND positive_seeds+1>=4 AND combined>0.55 AND cwt>=temporal-0.01 AND d>=0.005 AND positive_seeds-negative_seeds>0 THEN 'STRONG GO'
        WHEN ci>0 AND positive_seeds+1>=4 AND combined>0.55 AND cwt>=temporal-0.01 AND d>=0.002 THEN 'MODERATE GO' ELSE 'NO-GO FOR ADAPTIVE FUSION' END AS reliability,
      CASE WHEN NOT checks_ok THEN 'INCONCLUSIVE' WHEN candidate%2=0 AND combined>=0.66 THEN 'GO' ELSE 'PIVOT' END AS audit FROM f""",
)
def study_verdicts(spark, sf):
    d = F.col("delta_c_given_t")
    rows = summary(spark, sf).withColumns(
        {
            "best_individual_mcc": F.col("combined"), "delta": d, "ci_low": d - 0.002, "error_reduction": d,
            "oracle_delta": F.abs(d), "recoverable": F.when(F.col("temporal") < 0.62, 0.1).otherwise(0.2),
        }
    )
    second = rows.select(
        "*", d.alias("mean_delta"), (F.col("positive_seeds") - F.col("negative_seeds")).alias("net_error_reduction"),
        F.col("combined").alias("reliability_auc"), F.col("cwt").alias("adaptive_recall"), F.col("temporal").alias("fixed_recall"),
    ).withColumn("positive_seeds", F.col("positive_seeds") + 1)
    alignment = F.when(F.col("candidate") % 2 == 0, "VALID").otherwise("INVALID")
    return second.select(
        "candidate",
        g.conservative_study_verdict().alias("conservative"),
        g.reliability_study_verdict().alias("reliability"),
        g.audit_verdict(F.col("checks_ok"), alignment, F.col("combined") - 0.06).alias("audit"),
    )


@query(
    "fusion_verdict",
    f"""WITH {RECORDS}, {SUMMARY}, d AS (SELECT candidate % 2 AS dataset, max(positive_seeds)+1 AS ap, min(3-negative_seeds)+2 AS st, min(delta_c_given_t) AS ci FROM summary GROUP BY 1),
      r AS (SELECT min(ap) AS adaptive_min, max(ap) AS adaptive_max, min(st) AS static_min, min(ci) AS ci FROM d)
    SELECT adaptive_min, adaptive_max, static_min, round(ci,6) AS ci, CASE WHEN adaptive_min>=4 AND ci>0 THEN 'ADAPTIVE FUSION CONFIRMED ACROSS DATASETS' WHEN static_min>=4 AND adaptive_max>=3 THEN 'ADAPTIVE FUSION PARTIALLY SUPPORTED'
      WHEN static_min>=4 THEN 'STATIC MULTIMODAL FUSION CONFIRMED; ADAPTIVE NOT CONFIRMED' WHEN adaptive_max>=3 THEN 'DATASET-DEPENDENT FUSION BENEFIT' ELSE 'FUSION NOT CONFIRMED' END AS verdict FROM r""",
)
def fusion_verdict(spark, sf):
    per = summary(spark, sf).groupBy((F.col("candidate") % 2).alias("dataset")).agg(
        (F.max("positive_seeds") + 1).alias("adaptive_positive"),
        (F.min(3 - F.col("negative_seeds")) + 2).alias("static_positive"),
        F.min("delta_c_given_t").alias("adaptive_lowest_ci"),
    )
    return rounded(g.fusion_verdict(per))
