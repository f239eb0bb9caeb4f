"""Metrics over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import metrics as m
from sigloom.operators.ordering import exact_quantiles, global_rank
from sigloom.plans import inputs as src
from sigloom.plans.registry import query, rounded

RATES = """
  round(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn-fp*fn)/(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))) ELSE 0 END, 6) AS mcc,
  round((tp+tn)/(tp+tn+fp+fn), 6) AS accuracy,
  round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tn+fp > 0 THEN tn/(tn+fp) ELSE 0 END, 6) AS specificity,
  round(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1,
  round((tp+fp)/(tp+tn+fp+fn), 6) AS positive_fraction,
  CAST(fp+fn AS BIGINT) AS errors
"""
COUNTS = """
  sum(CASE WHEN target=0 AND d=0 THEN 1 ELSE 0 END)::DOUBLE AS tn,
  sum(CASE WHEN target=0 AND d=1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
  sum(CASE WHEN target=1 AND d=0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
  sum(CASE WHEN target=1 AND d=1 THEN 1 ELSE 0 END)::DOUBLE AS tp
"""
BIG = "CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp"
BY = ["seed", "split", "method"]
SQL_MCC = "CASE WHEN ({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}) > 0 THEN ({tp}*{tn}-{fp}*{fn})/(sqrt(({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))) ELSE 0 END"


@query(
    "binary_metrics",
    f"""WITH {src.PREDICTIONS}, c AS (SELECT seed, split, method, {COUNTS}
      FROM (SELECT *, CAST(probability >= threshold AS INT) AS d FROM predictions) GROUP BY ALL)
    SELECT seed, split, method, {BIG}, {RATES} FROM c""",
)
def binary_metrics(spark, sf):
    return rounded(m.binary_metrics(src.predictions(spark, sf), BY))


@query(
    "line_score_metrics",
    f"""WITH {src.LINES}, c AS (SELECT method, {COUNTS}
      FROM (SELECT *, CAST(probability >= threshold AS INT) AS d FROM lines) GROUP BY ALL)
    SELECT method, {BIG}, {RATES} FROM c""",
)
def line_score_metrics(spark, sf):
    return rounded(m.binary_metrics(src.lines(spark, sf), ["method"]))


AUC_SQL = """
  steps AS (SELECT {by}, probability, sum(target)::DOUBLE AS pos, sum(1-target)::DOUBLE AS neg FROM {t} GROUP BY ALL),
  cum AS (SELECT *, sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n,
     sum(neg) OVER (PARTITION BY {by} ORDER BY probability) - neg AS neg_below,
     sum(pos) OVER (PARTITION BY {by} ORDER BY probability DESC) AS tp,
     sum(neg) OVER (PARTITION BY {by} ORDER BY probability DESC) AS fp FROM steps)
"""


@query(
    "roc_auc",
    f"""WITH {src.PREDICTIONS}, {AUC_SQL.format(by='seed, split, method', t='predictions')}
    SELECT seed, split, method, CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
      round(sum(pos*(neg_below+0.5*neg))/max(p*n), 6) AS roc_auc FROM cum GROUP BY seed, split, method""",
)
def roc_auc(spark, sf):
    return rounded(m.roc_auc(src.predictions(spark, sf), BY))


@query(
    "average_precision",
    f"""WITH {src.PREDICTIONS}, {AUC_SQL.format(by='seed, split, method', t='predictions')}
    SELECT seed, split, method, round(sum(pos*(tp/(tp+fp)))/max(p), 6) AS average_precision FROM cum GROUP BY seed, split, method""",
)
def average_precision(spark, sf):
    return rounded(m.average_precision(src.predictions(spark, sf), BY))


@query(
    "line_ranking_metrics",
    f"""WITH {src.LINES}, {AUC_SQL.format(by='method', t='lines')}
    SELECT method, CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
      round(sum(pos*(neg_below+0.5*neg))/max(p*n), 6) AS roc_auc,
      round(sum(pos*(tp/(tp+fp)))/max(p), 6) AS average_precision FROM cum GROUP BY method""",
)
def line_ranking_metrics(spark, sf):
    return rounded(m.ranking_metrics(src.lines(spark, sf), ["method"]))


@query(
    "cumulative_counts",
    f"""WITH {src.LINES}, s AS (SELECT method, probability, sum(target) AS pos, sum(1-target) AS neg FROM lines GROUP BY ALL)
    SELECT method, probability, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
      CAST(sum(pos) OVER w - pos AS BIGINT) AS pos_before, CAST(sum(neg) OVER w - neg AS BIGINT) AS neg_before
    FROM s WINDOW w AS (PARTITION BY method ORDER BY probability)""",
)
def cumulative_counts(spark, sf):
    return m.cumulative_counts(src.lines(spark, sf), ["method"])


@query(
    "brier",
    f"""WITH {src.PREDICTIONS} SELECT seed, split, method, round(avg((probability-target)*(probability-target)), 6) AS brier
    FROM predictions GROUP BY ALL""",
)
def brier(spark, sf):
    return rounded(m.brier(src.predictions(spark, sf), BY))


@query(
    "log_loss",
    f"""WITH {src.PREDICTIONS}, c AS (SELECT *, least(greatest(probability, 1e-7), 1-1e-7) AS p FROM predictions)
    SELECT seed, split, method, round(avg(-CASE WHEN target=1 THEN ln(p) ELSE ln(1-p) END), 6) AS log_loss FROM c GROUP BY ALL""",
)
def log_loss(spark, sf):
    return rounded(m.log_loss(src.predictions(spark, sf), BY))


BINS_SQL = """bins AS (SELECT seed, split, method, CAST(least(9, floor(probability*10)) AS INT) AS bin,
   count(*) AS n, avg(probability) AS mp, avg(target) AS obs FROM predictions GROUP BY ALL)"""


@query(
    "ece",
    f"""WITH {src.PREDICTIONS}, {BINS_SQL} SELECT seed, split, method, round(sum(n*abs(mp-obs))/sum(n), 6) AS ece
    FROM bins GROUP BY ALL""",
)
def ece(spark, sf):
    return rounded(m.ece(src.predictions(spark, sf), BY))


@query(
    "reliability_points",
    f"""WITH {src.PREDICTIONS}, {BINS_SQL} SELECT seed, split, method, bin, n, round(mp, 6) AS mean_probability,
      round(obs, 6) AS observed_rate FROM bins""",
)
def reliability_points(spark, sf):
    return rounded(m.reliability_points(src.predictions(spark, sf), BY))


@query(
    "reliability_deciles",
    f"""WITH {src.PAIR}, r AS (SELECT seed, p_temporal, CAST(d_temporal = target AS INT) AS hit,
       row_number() OVER (PARTITION BY seed ORDER BY p_temporal, sample_id) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n FROM pair)
    SELECT seed, CAST(greatest((pos*10 + (n-1) - 1) // (n-1) - 1, 0) AS INT) AS decile, count(*) AS n,
      round(avg(p_temporal), 6) AS mean_reliability, round(avg(hit), 6) AS mean_outcome FROM r GROUP BY seed, decile""",
)
def reliability_deciles(spark, sf):
    p = src.pair(spark, sf).withColumn("hit", (F.col("d_temporal") == F.col("target")).cast("int"))
    return rounded(m.reliability_deciles(p, ["seed"], "p_temporal", "hit"))


@query(
    "rank_first",
    f"""WITH {src.PAIR} SELECT sample_id, seed,
      row_number() OVER (PARTITION BY seed ORDER BY p_spectral, sample_id) AS rank FROM pair""",
)
def rank_first(spark, sf):
    ranked = global_rank(src.pair(spark, sf), ["seed"], ["p_spectral", "sample_id"])
    return ranked.select("sample_id", "seed", "rank")


@query(
    "probability_summary",
    f"""WITH {src.PREDICTIONS} SELECT method, count(*) AS count, min(probability) AS min, max(probability) AS max,
      round(avg(probability), 6) AS mean, round(quantile_cont(probability, 0.01), 6) AS p01, round(quantile_cont(probability, 0.1), 6) AS p10,
      round(quantile_cont(probability, 0.5), 6) AS median, round(quantile_cont(probability, 0.9), 6) AS p90,
      round(quantile_cont(probability, 0.99), 6) AS p99 FROM predictions GROUP BY method""",
)
def probability_summary(spark, sf):
    return rounded(m.probability_summary(src.predictions(spark, sf), ["method"]))


@query(
    "noise_stats",
    """WITH c AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
      d AS (SELECT e.event_type, med, value, abs(value-med) AS dev FROM events e JOIN c USING (event_type))
    SELECT event_type, round(max(med), 6) AS median, round(quantile_cont(dev, 0.5)*1.4826, 6) AS mad_std,
      round(stddev_pop(value), 6) AS std, round(quantile_cont(dev, 0.01), 6) AS p01_abs, round(quantile_cont(dev, 0.5), 6) AS p50_abs,
      round(quantile_cont(dev, 0.9), 6) AS p90_abs, round(quantile_cont(dev, 0.99), 6) AS p99_abs FROM d GROUP BY 1""",
)
def noise_stats(spark, sf):
    e = src.table(spark, sf, "events").select("event_type", "value")
    return rounded(m.noise_stats(e, ["event_type"], "value"))


@query(
    "exact_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(median(l_extendedprice), 6) AS q50,
      round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY 1""",
)
def quantiles(spark, sf):
    l = src.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(exact_quantiles(l, ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q75": 0.75}))


METRIC_ROWS = f"""c AS (SELECT seed, split, method, {COUNTS}
      FROM (SELECT *, prediction AS d FROM predictions) GROUP BY ALL),
   metrics AS (SELECT seed, split, method, {SQL_MCC.format(tp='tp', tn='tn', fp='fp', fn='fn')} AS mcc FROM c)"""


def method_metrics(spark, sf):
    return m.binary_metrics(src.predictions(spark, sf), BY, prediction="prediction")


@query(
    "seed_by_method",
    f"""WITH {src.PREDICTIONS}, {METRIC_ROWS}, w AS (SELECT seed, max(CASE WHEN method='temporal' THEN mcc END) AS t,
       max(CASE WHEN method='spectral' THEN mcc END) AS s FROM metrics WHERE split='validation' GROUP BY seed)
    SELECT seed, round(t,6) AS temporal, round(s,6) AS spectral, round(s-t,6) AS spectral_minus_temporal FROM w""",
)
def seed_by_method(spark, sf):
    rows = method_metrics(spark, sf).where("split = 'validation'")
    return rounded(m.seed_by_method(rows, list(src.METHODS), "temporal"))


@query(
    "summarize_methods",
    f"""WITH {src.PREDICTIONS}, {METRIC_ROWS} SELECT split, method, count(*) AS n, round(avg(mcc),6) AS mean,
      round(stddev_samp(mcc),6) AS std, round(min(mcc),6) AS min, round(max(mcc),6) AS max FROM metrics GROUP BY split, method""",
)
def summarize_methods(spark, sf):
    return rounded(m.summarize_methods(method_metrics(spark, sf), ["split", "method"]))


@query(
    "summarize_deltas",
    f"""WITH {src.PREDICTIONS}, {METRIC_ROWS}, d AS (SELECT a.split, b.mcc - a.mcc AS delta FROM metrics a JOIN metrics b
       ON a.seed=b.seed AND a.split=b.split AND a.method='temporal' AND b.method='spectral')
    SELECT split, count(*) AS n_seeds, round(avg(delta),6) AS mean, round(stddev_samp(delta),6) AS sd, round(median(delta),6) AS median,
      count(*) FILTER (delta > 0) AS positive_seeds, count(*) FILTER (delta >= 0.005) AS target_reached_seeds FROM d GROUP BY split""",
)
def summarize_deltas(spark, sf):
    rows = method_metrics(spark, sf).groupBy("split", "seed").pivot("method", list(src.METHODS)).agg(F.first("mcc"))
    return rounded(m.summarize_deltas(rows.withColumn("delta", F.col("spectral") - F.col("temporal")), ["split"]))


@query(
    "correctness_category",
    f"""WITH {src.PAIR} SELECT sample_id, CASE WHEN d_temporal=target AND d_spectral=target THEN 'both_correct'
      WHEN d_temporal=target THEN 'a_only' WHEN d_spectral=target THEN 'b_only' ELSE 'both_wrong' END AS category FROM pair""",
)
def correctness_category(spark, sf):
    return src.pair(spark, sf).select(
        "sample_id", m.correctness_category("target", "d_temporal", "d_spectral").alias("category")
    )


STATES = """tagged AS (SELECT seed, target, CASE WHEN d_temporal=target AND d_spectral=target THEN 'both_correct'
      WHEN d_temporal=target THEN 'a_only' WHEN d_spectral=target THEN 'b_only' ELSE 'both_wrong' END AS state FROM pair)"""


@query(
    "overlap_states",
    f"""WITH {src.PAIR}, {STATES},
      strata AS (SELECT seed, 'all' AS stratum, state FROM tagged UNION ALL
        SELECT seed, CASE WHEN target=1 THEN 'PD' ELSE 'NonPD' END, state FROM tagged),
      spine AS (SELECT DISTINCT s.seed, s.stratum, v.state FROM strata s CROSS JOIN (VALUES ('both_correct'),('a_only'),('b_only'),('both_wrong')) v(state)),
      tot AS (SELECT seed, stratum, count(*) AS n FROM strata GROUP BY ALL),
      cnt AS (SELECT seed, stratum, state, count(*) AS k FROM strata GROUP BY ALL)
    SELECT spine.seed, spine.stratum, spine.state, coalesce(k, 0) AS count, round(coalesce(k,0)/n, 6) AS fraction
    FROM spine JOIN tot USING (seed, stratum) LEFT JOIN cnt USING (seed, stratum, state)""",
)
def overlap_states(spark, sf):
    return rounded(m.overlap_states(src.pair(spark, sf), ["seed"], "target", "d_temporal", "d_spectral"))


def sql_mcc_of(decision: str) -> str:
    tp, tn = f"sum(CAST(target=1 AND {decision}=1 AS INT))::DOUBLE", f"sum(CAST(target=0 AND {decision}=0 AS INT))::DOUBLE"
    fp, fn = f"sum(CAST(target=0 AND {decision}=1 AS INT))::DOUBLE", f"sum(CAST(target=1 AND {decision}=0 AS INT))::DOUBLE"
    return SQL_MCC.format(tp=tp, tn=tn, fp=fp, fn=fn)


@query(
    "overlap_oracle",
    f"""WITH {src.PAIR}, o AS (SELECT *, CASE WHEN d_temporal=target THEN d_temporal ELSE d_spectral END AS d_oracle FROM pair),
      r AS (SELECT seed, avg(CAST(d_temporal<>d_spectral AS INT)) AS dis, {sql_mcc_of('d_temporal')} AS a, {sql_mcc_of('d_spectral')} AS b,
         {sql_mcc_of('d_oracle')} AS o FROM o GROUP BY seed)
    SELECT seed, round(dis,6) AS disagreement_rate, round(a,6) AS a_mcc, round(b,6) AS b_mcc, round(o,6) AS oracle_mcc,
      round(greatest(a,b),6) AS stronger_mcc, round(o-greatest(a,b),6) AS oracle_headroom FROM r""",
)
def overlap_oracle(spark, sf):
    return rounded(m.overlap_oracle(src.pair(spark, sf), ["seed"], "target", "d_temporal", "d_spectral"))


@query(
    "oracle_decision",
    f"""WITH {src.PAIR} SELECT sample_id, CASE WHEN d_temporal=target THEN d_temporal ELSE d_spectral END AS d_oracle FROM pair""",
)
def oracle_decision(spark, sf):
    return src.pair(spark, sf).select(
        "sample_id", m.oracle_decision("target", "d_temporal", "d_spectral").alias("d_oracle")
    )


@query(
    "complementarity",
    f"""WITH {src.PAIR} SELECT seed, round(corr(p_temporal, p_spectral),6) AS probability_correlation,
      round(avg(CAST(d_temporal<>d_spectral AS INT)),6) AS disagreement_rate,
      count(*) FILTER (d_temporal=target AND d_spectral<>target) AS a_exclusive_correct,
      count(*) FILTER (d_temporal<>target AND d_spectral=target) AS b_exclusive_correct FROM pair GROUP BY seed""",
)
def complementarity(spark, sf):
    return rounded(
        m.complementarity(
            src.pair(spark, sf), ["seed"], "target", "p_temporal", "p_spectral", "d_temporal", "d_spectral"
        )
    )


@query(
    "error_transitions",
    f"""WITH {src.PAIR} SELECT seed, split, count(*) FILTER (d_temporal<>target AND d_spectral=target) AS corrected,
      count(*) FILTER (d_temporal=target AND d_spectral<>target) AS introduced,
      count(*) FILTER ((d_temporal=target) = (d_spectral=target)) AS unchanged,
      count(*) FILTER (d_temporal<>target AND d_spectral=target) - count(*) FILTER (d_temporal=target AND d_spectral<>target) AS net
      FROM pair GROUP BY seed, split""",
)
def error_transitions(spark, sf):
    return m.error_transitions(src.pair(spark, sf), ["seed", "split"], "target", "d_temporal", "d_spectral")


@query(
    "override_stats",
    f"""WITH {src.PAIR}, f AS (SELECT *, CASE WHEN p_spectral >= 0.6 THEN d_spectral ELSE d_temporal END AS fin FROM pair),
      c AS (SELECT seed, count(*) FILTER (fin<>d_temporal) AS overrides, count(*) FILTER (fin<>d_temporal AND d_temporal<>target) AS beneficial,
        count(*) FILTER (fin<>d_temporal AND d_temporal=target) AS harmful, count(*) FILTER (d_temporal<>target) AS anchor_errors FROM f GROUP BY seed)
    SELECT seed, overrides, beneficial, harmful, anchor_errors, round(CASE WHEN overrides>0 THEN beneficial/overrides ELSE 0 END,6) AS override_precision,
      beneficial-harmful AS net, round(CASE WHEN anchor_errors>0 THEN beneficial/anchor_errors ELSE 0 END,6) AS recovered_fraction FROM c""",
)
def override_stats(spark, sf):
    p = src.pair(spark, sf).withColumn(
        "final", F.when(F.col("p_spectral") >= 0.6, F.col("d_spectral")).otherwise(F.col("d_temporal"))
    )
    return rounded(m.override_stats(p, ["seed"], "target", "d_temporal", "final"))


@query(
    "shift_summary",
    f"""WITH {src.PAIR} SELECT split, count(*) AS n, round(avg(CAST(d_temporal<>d_spectral AS INT)),6) AS disagreement_rate,
      round(coalesce(avg(CASE WHEN d_temporal<>d_spectral THEN CAST(d_temporal=target AS INT) END),0),6) AS a_correct_given_disagreement,
      round(coalesce(avg(CASE WHEN d_temporal<>d_spectral THEN CAST(d_spectral=target AS INT) END),0),6) AS b_correct_given_disagreement,
      round(avg(p_temporal),6) AS reliability_mean, round(quantile_cont(p_temporal,0.1),6) AS reliability_p10,
      round(quantile_cont(p_temporal,0.9),6) AS reliability_p90 FROM pair GROUP BY split""",
)
def shift_summary(spark, sf):
    return rounded(
        m.shift_summary(src.pair(spark, sf), ["split"], "target", "d_temporal", "d_spectral", "p_temporal")
    )


@query(
    "mcnemar",
    f"""WITH {src.PAIR}, c AS (SELECT seed, split, count(*) FILTER (d_temporal<>target AND d_spectral=target) AS b,
       count(*) FILTER (d_temporal=target AND d_spectral<>target) AS c FROM pair GROUP BY seed, split),
     t AS (SELECT seed, split, unnest(generate_series(0, least(b,c))) AS k, b, c FROM c),
     p AS (SELECT seed, split, sum(exp(lgamma(b+c+1) - lgamma(k+1) - lgamma(b+c-k+1) - (b+c)*ln(2))) AS tail FROM t GROUP BY ALL)
    SELECT seed, split, b AS a_wrong_b_correct, c AS a_correct_b_wrong,
      round(CASE WHEN b+c>0 THEN (abs(b-c)-1)*(abs(b-c)-1)/(b+c) ELSE 0 END, 6) AS chi_square,
      round(CASE WHEN b+c=0 THEN 1 ELSE least(1, 2*tail) END, 6) AS p_value FROM c JOIN p USING (seed, split)""",
)
def mcnemar(spark, sf):
    return rounded(m.mcnemar(src.pair(spark, sf), ["seed", "split"], "target", "d_temporal", "d_spectral"))


@query(
    "evaluate_methods",
    f"""WITH {src.PREDICTIONS}, c AS (SELECT seed, split, method, max(threshold) AS threshold, {COUNTS},
        avg((probability-target)*(probability-target)) AS brier
      FROM (SELECT *, CAST(probability >= threshold AS INT) AS d FROM predictions) GROUP BY ALL),
      {BINS_SQL}, e AS (SELECT seed, split, method, sum(n*abs(mp-obs))/sum(n) AS ece FROM bins GROUP BY ALL),
      {AUC_SQL.format(by='seed, split, method', t='predictions')},
      r AS (SELECT seed, split, method, sum(pos*(neg_below+0.5*neg))/max(p*n) AS auc, sum(pos*(tp/(tp+fp)))/max(p) AS ap
         FROM cum GROUP BY seed, split, method)
    SELECT 'wide' AS dataset, seed, split, method, threshold, {BIG}, {RATES}, round(brier,6) AS brier, round(ece,6) AS ece,
      round(auc,6) AS roc_auc, round(ap,6) AS average_precision
    FROM c JOIN e USING (seed, split, method) JOIN r USING (seed, split, method)""",
)
def evaluate_methods(spark, sf):
    return rounded(m.evaluate_methods(src.predictions(spark, sf)))
