"""Filters, joins, audits and key-set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions import scalars as s
from sigloom.operators import audits, checks, joins
from sigloom.operators import projections as pr
from sigloom.plans import inputs as src
from sigloom.plans.registry import query, rounded

# Filters and value rules --------------------------------------------------------------


@query(
    "development_only",
    f"""WITH {src.SIGNALS} SELECT sample_id, split, target FROM signals WHERE split = 'train'""",
)
def development_only(spark, sf):
    return pr.development_only(src.signals(spark, sf), ["train"]).select("sample_id", "split", "target")


@query(
    "holdout_rows",
    f"""WITH {src.PREDICTIONS} SELECT sample_id, method, split FROM predictions
    WHERE split IN ('test','test_confirmatory','test_grouped_holdout','official_unlabeled_test') OR (dataset='wide' AND split='validation')""",
)
def holdout_rows(spark, sf):
    rows = pr.holdout_rows(src.predictions(spark, sf), blocked_pairs=[("wide", "validation")])
    return rows.select("sample_id", "method", "split")


@query(
    "decide",
    f"""WITH {src.PREDICTIONS} SELECT sample_id, method, CAST(probability >= threshold AS INT) AS prediction FROM predictions""",
)
def decide(spark, sf):
    return pr.decide(src.predictions(spark, sf)).select("sample_id", "method", "prediction")


@query(
    "repair_predictions",
    f"""WITH {src.PREDICTIONS} SELECT sample_id, method, coalesce(CASE WHEN sample_id % 4 = 0 THEN NULL ELSE 1 - prediction END,
      CAST(probability >= threshold AS INT)) AS prediction FROM predictions""",
)
def repair_predictions(spark, sf):
    holed = src.predictions(spark, sf).withColumn(
        "prediction", F.when(F.col("sample_id") % 4 != 0, F.lit(1) - F.col("prediction"))
    )
    return pr.repair_predictions(holed).select("sample_id", "method", "prediction")


@query(
    "replace_rows",
    f"""WITH {src.PREDICTIONS}, fresh AS (SELECT sample_id, method, 1 - probability AS probability FROM predictions WHERE split='validation')
    SELECT sample_id, method, round(probability, 6) AS probability FROM predictions WHERE split <> 'validation'
    UNION ALL SELECT sample_id, method, round(probability, 6) FROM fresh""",
)
def replace_rows(spark, sf):
    base = src.predictions(spark, sf)
    fresh = base.where("split = 'validation'").withColumn("probability", 1 - F.col("probability"))
    out = pr.replace_rows(base, fresh, ["dataset", "seed", "split", "sample_id", "method"])
    return rounded(out.select("sample_id", "method", "probability"))


NON_FINITE = """CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE
   WHEN event_id % 13 = 0 THEN '-Infinity'::DOUBLE ELSE value END"""


def non_finite(spark, sf):
    e = src.table(spark, sf, "events").select("event_id", "value")
    return e.withColumn(
        "x",
        F.when(F.col("event_id") % 7 == 0, float("nan"))
        .when(F.col("event_id") % 11 == 0, float("inf"))
        .when(F.col("event_id") % 13 == 0, float("-inf"))
        .otherwise(F.col("value")),
    )


@query(
    "finite_zero",
    f"""WITH e AS (SELECT event_id, {NON_FINITE} AS x FROM events)
    SELECT event_id, CASE WHEN isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 1e6 WHEN x = '-Infinity'::DOUBLE THEN -1e6 ELSE x END AS x FROM e""",
)
def finite_zero(spark, sf):
    return pr.finite(non_finite(spark, sf), ["x"]).select("event_id", "x")


@query(
    "impute_median",
    f"""WITH e AS (SELECT event_id, {NON_FINITE} AS x FROM events),
      m AS (SELECT median(x) AS med FROM e WHERE isfinite(x) AND event_id % 5 <> 0)
    SELECT event_id, round(CASE WHEN isfinite(x) THEN x ELSE med END, 6) AS x FROM e, m""",
)
def impute_median(spark, sf):
    df = non_finite(spark, sf)
    return rounded(pr.finite(df, ["x"], "median", fit=df.where("event_id % 5 <> 0")).select("event_id", "x"))


@query(
    "column_medians",
    """SELECT 'l_quantity' AS column, median(l_quantity) AS median FROM lineitem UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem
     UNION ALL SELECT 'l_extendedprice', median(l_extendedprice) FROM lineitem""",
)
def column_medians(spark, sf):
    l = src.table(spark, sf, "lineitem")
    return pr.column_medians_frame(l, ["l_quantity", "l_discount", "l_extendedprice"])


@query(
    "check_probabilities",
    f"""WITH {src.PREDICTIONS} SELECT count(*) AS rows, count(*) FILTER (NOT isfinite(probability)) AS non_finite,
      count(*) FILTER (isfinite(probability) AND NOT (probability BETWEEN 0 AND 1)) AS out_of_range,
      count(*) FILTER (target IS NULL OR target NOT IN (0,1)) AS bad_target FROM predictions""",
)
def check_probabilities(spark, sf):
    return pr.probability_violations(pr.check_probabilities(src.predictions(spark, sf)))


@query(
    "structural_zero",
    """SELECT d.doc_id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::DOUBLE AS toxic,
      CAST(quality IS NULL AND toxic IS NULL AS INT) AS structural_missing FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def structural_zero(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id")
    joined = joins.join_one_to_one(d, src.table(spark, sf, "labels"), ["doc_id"])
    return pr.structural_zero(joined, ["quality", "toxic"])


@query(
    "context_rows",
    f"""WITH {src.PREDICTIONS} SELECT seed, method, threshold FROM predictions WHERE lower(split) = 'validation'""",
)
def context_rows(spark, sf):
    shouted = src.predictions(spark, sf).withColumn("split", F.upper("split"))
    return pr.context_rows(shouted)


@query(
    "prefixed",
    """SELECT l_orderkey, l_linenumber, l_discount AS cwt_l_discount, l_tax AS cwt_l_tax FROM lineitem""",
)
def prefixed(spark, sf):
    l = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    named = pr.prefixed(l, "cwt_", ["l_orderkey", "l_linenumber"])
    return named.select("l_orderkey", "l_linenumber", *pr.by_prefix(named, "cwt_"))


@query(
    "slice_exact",
    """SELECT event_id, user_id FROM events WHERE event_type = 'view'""",
)
def slice_exact(spark, sf):
    e = src.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    n = e.where("event_type = 'view'").count()
    return pr.slice_exact(e, F.col("event_type") == "view", n, "event_id").select("event_id", "user_id")


@query("union_results", """SELECT event_id, user_id, NULL::DOUBLE AS value FROM events WHERE value < 50
   UNION ALL SELECT event_id, NULL, value FROM events WHERE value >= 50""")
def union_results(spark, sf):
    e = src.table(spark, sf, "events")
    return pr.union_results(
        e.where("value < 50").select("event_id", "user_id"), e.where("value >= 50").select("value", "event_id")
    )


@query("common_values", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def common_values(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = src.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return pr.common_values(o, c, ["k"])


@query("missing_values", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_values(spark, sf):
    """Customers without an order."""
    o = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return pr.missing_values(c, o, ["k"])


@query(
    "profile_schema",
    """WITH t AS (SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
        WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type FROM information_schema.columns WHERE table_name = 'lineitem')
    SELECT type, count(*) AS columns, count(*) AS nullable_columns, (SELECT count(*) FROM lineitem) AS rows FROM t GROUP BY type""",
)
def profile_schema(spark, sf):
    return pr.profile_schema(src.table(spark, sf, "lineitem"))


@query(
    "feature_family_means",
    f"""WITH {src.TRIPLES} SELECT 'S' AS family, 2::BIGINT AS columns, round(avg(x), 6) AS mean_of_first FROM triples
     UNION ALL SELECT 'S+T', 3, round(avg(x), 6) FROM triples UNION ALL SELECT 'S+C', 3, round(avg(x), 6) FROM triples
     UNION ALL SELECT 'S+T+C', 4, round(avg(x), 6) FROM triples""",
)
def feature_family_means(spark, sf):
    """Feature sets chosen by family from a feature table, in canonical order."""
    t = src.triples(spark, sf).select(
        F.col("x").alias("current_candidate_count"),
        (F.col("x") * 2).alias("current_score_median"),
        (F.col("x") * 3).alias("cwt_entropy"),
        (F.col("x") * 4).alias("current_quadrant_00_count"),
    )
    inventory = pr.feature_inventory(t.columns)
    picks = [(name, pr.feature_set(inventory, name)) for name in pr.FEATURE_SETS]
    means = t.agg(*[F.avg(cols[0]).alias(f"m{k}") for k, (_, cols) in enumerate(picks)])
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("family"),
                    F.lit(len(cols)).cast("bigint").alias("columns"),
                    F.col(f"m{k}").alias("mean_of_first"),
                )
                for k, (name, cols) in enumerate(picks)
            ]
        )
    )
    return rounded(means.select(rows.alias("r")).select("r.*"))


# Joins --------------------------------------------------------------------------------


@query(
    "join_one_to_one",
    "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)",
)
def join_one_to_one(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", "lang")
    return joins.join_one_to_one(d, src.table(spark, sf, "labels"), ["doc_id"])


@query(
    "join_many_to_one",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def join_many_to_one(spark, sf):
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.join_many_to_one(o, c, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("lookup", "SELECT o_orderkey AS k, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def lookup(spark, sf):
    o = src.table(spark, sf, "orders")
    wanted = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"))
    return joins.lookup(o.select(F.col("o_orderkey").alias("k"), "o_totalprice"), wanted, ["k"])


@query(
    "pair_experts",
    f"""WITH {src.PREDICTIONS} SELECT a.dataset, a.seed, a.split, a.sample_id, a.id_measurement, a.phase, a.target,
       a.probability AS probability_temporal, b.probability AS probability_spectral,
       a.threshold AS threshold_temporal, b.threshold AS threshold_spectral
     FROM predictions a JOIN predictions b USING (sample_id) WHERE a.method='temporal' AND b.method='spectral'""",
)
def pair_experts(spark, sf):
    return joins.pair_experts(src.predictions(spark, sf), "temporal", "spectral")


@query(
    "keep_groups",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def keep_groups(spark, sf):
    urgent = src.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    l = src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.keep_groups(l, urgent, ["l_orderkey"])


@query(
    "key_comparison",
    """WITH l AS (SELECT doc_id, count(*) n FROM documents GROUP BY 1), r AS (SELECT doc_id, count(*) n FROM labels GROUP BY 1),
       j AS (SELECT coalesce(l.n,0) AS l, coalesce(r.n,0) AS r FROM l FULL JOIN r USING (doc_id))
    SELECT count(*) FILTER (r=0) AS only_left, count(*) FILTER (l=0) AS only_right, count(*) FILTER (l>1) AS repeated_left,
      count(*) FILTER (r>1) AS repeated_right, count(*) FILTER (l=1 AND r=1) AS matched FROM j""",
)
def key_comparison(spark, sf):
    return joins.key_comparison(src.table(spark, sf, "documents"), src.table(spark, sf, "labels"), ["doc_id"])


@query(
    "group_overlap",
    """SELECT user_id AS id_measurement, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS splits FROM events
       GROUP BY user_id HAVING count(DISTINCT event_type) > 1""",
)
def group_overlap(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("user_id").alias("id_measurement"), F.col("event_type").alias("split"))
    return joins.group_overlap(e)


@query(
    "pairwise",
    """WITH v AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL)
    SELECT a.user_id, a.event_type AS left_item, b.event_type AS right_item, a.v AS left_value, b.v AS right_value
    FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type < b.event_type""",
)
def pairwise(spark, sf):
    e = src.table(spark, sf, "events").select("user_id", "event_type", "value")
    return joins.pairwise(e, ["user_id"], "event_type", ["click", "error", "purchase", "signup", "view"], "value")


@query(
    "nearest_bins",
    f"""WITH {src.SIGNALS}, b AS (SELECT DISTINCT CAST(round_even(k * 63.0 / 31, 0) AS INT) AS bin FROM range(32) r(k))
    SELECT sample_id, i AS bin, v FROM samples WHERE i IN (SELECT bin FROM b)""",
)
def nearest_bins(spark, sf):
    bins = joins.nearest_bins(32, 64)
    long = src.signals(spark, sf).select("sample_id", F.posexplode("values").alias("bin", "v"))
    return long.where(F.col("bin").isin(bins)).select("sample_id", F.col("bin").cast("bigint").alias("bin"), "v")


@query(
    "regression_check",
    """WITH m AS (SELECT l_returnflag AS method, avg(l_quantity) AS mcc FROM lineitem GROUP BY 1),
       e AS (SELECT method, CASE WHEN method = 'R' THEN mcc + 1e-3 ELSE mcc END AS mcc FROM m)
    SELECT e.method, round(e.mcc,6) AS expected, round(m.mcc,6) AS measured, CASE WHEN abs(m.mcc-e.mcc) <= 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM e LEFT JOIN m USING (method)""",
)
def regression_check(spark, sf):
    m = src.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("mcc"))
    e = m.withColumn("mcc", F.when(F.col("method") == "R", F.col("mcc") + 1e-3).otherwise(F.col("mcc")))
    return rounded(joins.regression_check(m, e, ["method"], 1e-6))


# Audits -------------------------------------------------------------------------------


@query(
    "audit_metadata",
    f"""WITH {src.TRIPLES}, g AS (SELECT id_measurement, count(*) AS n, count(DISTINCT phase) AS p, min(target) AS lo, max(target) AS hi, sum(target) AS pos
        FROM triples GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, count(*) FILTER (n<>3) AS groups_without_three_rows,
      count(*) FILTER (p<>3) AS groups_without_three_phases, count(*) FILTER (lo<>hi) AS mixed_label_groups,
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n)-sum(pos) AS BIGINT) AS negatives,
      (SELECT count(DISTINCT phase) FROM triples) AS distinct_phases FROM g""",
)
def audit_metadata(spark, sf):
    return audits.audit_metadata(src.triples(spark, sf))


@query(
    "audit_skewed_groups",
    """WITH m AS (SELECT user_id AS g, event_type AS phase, CAST(value > 40 AS INT) AS target FROM events),
      g AS (SELECT g, count(*) AS n, count(DISTINCT phase) AS p, min(target) AS lo, max(target) AS hi, sum(target) AS pos FROM m GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, count(*) FILTER (n<>3) AS groups_without_three_rows,
      count(*) FILTER (p<>3) AS groups_without_three_phases, count(*) FILTER (lo<>hi) AS mixed_label_groups,
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n)-sum(pos) AS BIGINT) AS negatives,
      (SELECT count(DISTINCT phase) FROM m) AS distinct_phases FROM g""",
)
def audit_skewed_groups(spark, sf):
    e = src.table(spark, sf, "events").select(
        F.col("user_id").alias("id_measurement"), F.col("event_type").alias("phase"), (F.col("value") > 40).cast("int").alias("target")
    )
    return audits.audit_metadata(e)


@query(
    "value_counts",
    """SELECT v AS value, count(event_id) AS count FROM (VALUES ('view'),('error'),('refund')) d(v) LEFT JOIN events ON event_type = v GROUP BY v""",
)
def value_counts(spark, sf):
    return audits.value_counts(src.table(spark, sf, "events"), "event_type", ["view", "error", "refund"])


@query(
    "phase_patterns",
    f"""WITH {src.TRIPLES}, g AS (SELECT id_measurement, string_agg(CAST(target AS VARCHAR), '' ORDER BY phase) AS p, count(*) AS n FROM triples GROUP BY 1)
    SELECT v AS pattern, count(p) AS measurements, round(count(p)/(SELECT count(*) FROM g), 6) AS proportion
    FROM (VALUES ('000'),('001'),('010'),('011'),('100'),('101'),('110'),('111')) d(v) LEFT JOIN g ON p = v AND n = 3 GROUP BY v""",
)
def phase_patterns(spark, sf):
    return rounded(audits.phase_patterns(src.triples(spark, sf)))


@query(
    "group_label_summary",
    f"""WITH {src.TRIPLES} SELECT id_measurement, count(*) AS rows, max(target) AS any_positive, CAST(sum(target)=count(*) AS INT) AS all_positive,
      CAST(min(target)<>max(target) AS INT) AS mixed FROM triples GROUP BY 1""",
)
def group_label_summary(spark, sf):
    return audits.group_label_summary(src.triples(spark, sf))


@query(
    "coalesce_rows",
    """SELECT user_id, max(CASE WHEN event_type='view' THEN value END) AS view_value, max(CASE WHEN event_type='error' THEN value END) AS error_value
       FROM events GROUP BY user_id""",
)
def coalesce_rows(spark, sf):
    e = src.table(spark, sf, "events").select(
        "user_id",
        F.when(F.col("event_type") == "view", F.col("value")).alias("view_value"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("error_value"),
    )
    return audits.coalesce_rows(e, ["user_id"])


@query(
    "to_group_level",
    f"""WITH {src.PAIR} SELECT id_measurement, round(avg(p_temporal),6) AS p_temporal, round(avg(p_spectral),6) AS p_spectral,
      max(target) AS target, arg_min(split, sample_id) AS split FROM pair GROUP BY 1""",
)
def to_group_level(spark, sf):
    return rounded(audits.to_group_level(src.pair(spark, sf), ["p_temporal", "p_spectral"]))


@query(
    "three_phase_features",
    f"""WITH {src.TRIPLES}, g AS (SELECT id_measurement, max(CASE WHEN phase='0' THEN x END) AS phase_0_x, max(CASE WHEN phase='1' THEN x END) AS phase_1_x,
        max(CASE WHEN phase='2' THEN x END) AS phase_2_x FROM triples GROUP BY 1 HAVING count(*) = 3)
    SELECT sample_id, id_measurement, phase, target, phase_0_x, phase_1_x, phase_2_x FROM triples JOIN g USING (id_measurement)""",
)
def three_phase_features(spark, sf):
    t = src.triples(spark, sf).drop("event_type")
    whole = joins.keep_groups(t, audits.complete_groups(t))
    return audits.three_phase_features(whole, ["x"])


ALIGN = """al AS (SELECT sample_id, id_measurement, CAST(x > {cut} AS INT) AS a, CAST(x > {cut} / 2 AS INT) AS b, 1 AS c, x AS d FROM triples),
   g AS (SELECT id_measurement, sum(a) AS h FROM al GROUP BY 1), u AS (SELECT d FROM al UNION ALL SELECT d / 2 FROM al),
   r AS (SELECT avg(a) AS ra, avg(b) AS rb, avg(c)::DOUBLE AS rc, avg(CAST(a=1 AND b=1 AS INT)) AS re FROM al)"""


@query(
    "alignment_status",
    f"""WITH {src.TRIPLES}, {ALIGN.format(cut=1.0)}
    SELECT round(ra,6) AS current_rate, round(rb,6) AS strict_rate, round(rc,6) AS sinusoid_rate, round(re,6) AS all_method_rate,
      round((SELECT avg(CAST(h = 3 AS INT)) FROM g),6) AS complete_group_rate, round((SELECT median(d) FROM u),6) AS median_disagreement,
      CASE WHEN ra >= 0.95 AND rb >= 0.95 AND rc >= 0.95 AND (SELECT avg(CAST(h = 3 AS INT)) FROM g) >= 0.95 AND (SELECT median(d) FROM u) <= 20 THEN 'VALID'
        WHEN ra >= 0.5 AND rb >= 0.5 AND rc >= 0.5 THEN 'PARTIAL/AMBIGUOUS' ELSE 'INVALID' END AS status FROM r""",
)
def alignment_status(spark, sf):
    """Alignment rules over success flags and angles derived from the event values."""
    t = src.triples(spark, sf)
    records = t.select(
        "sample_id", "id_measurement",
        (F.col("x") > 1.0).cast("int").alias("current_success"),
        (F.col("x") > 0.5).cast("int").alias("strict_success"),
        F.lit(1).alias("sinusoid_success"),
        F.array(F.col("x"), F.col("x") / 2).alias("disagreements"),
    )
    return rounded(audits.alignment_summary(records))


@query(
    "positive_class_weight",
    f"""WITH {src.SIGNALS} SELECT count(*) FILTER (target=0) AS negatives, count(*) FILTER (target=1) AS positives,
      round(count(*) FILTER (target=0) / count(*) FILTER (target=1), 6) AS positive_weight FROM signals WHERE split='train'""",
)
def positive_class_weight(spark, sf):
    return rounded(audits.positive_class_weight(src.signals(spark, sf)))


@query("duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return checks.duplicate_keys(src.table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("crosstab", f"WITH {src.PAIR} SELECT split, target, count(*) AS count FROM pair GROUP BY ALL")
def crosstab(spark, sf):
    return audits.crosstab(src.pair(spark, sf), "split", "target")


# Scalar functions ---------------------------------------------------------------------


@query(
    "scalar_functions",
    f"""WITH {src.PAIR}, c AS (SELECT *, least(greatest(p_temporal, 1e-6), 1-1e-6) AS p, least(greatest(p_spectral, 1e-7), 1-1e-7) AS q FROM pair)
    SELECT sample_id, round(1/(1+exp(-least(greatest((p_temporal-0.5)*100, -40), 40))), 6) AS sigmoid, round(ln(p/(1-p)), 6) AS logit,
      round(-(q*log2(q)+(1-q)*log2(1-q)), 6) AS entropy, round(abs(p_temporal-0.5), 6) AS margin, round(greatest(p_temporal, 1-p_temporal), 6) AS confidence,
      CASE WHEN (p_temporal>=0.5) = (p_spectral>=0.5) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS agreement,
      round(((p_temporal*1000 - 400 + 180) - 360*floor((p_temporal*1000 - 400 + 180)/360)) - 180, 6) AS degrees,
      round(ln(1+p_spectral), 6) AS log1p, sign(p_temporal-p_spectral)::DOUBLE AS sgn,
      printf('train:%08d', sample_id) AS padded, sha256(CAST(sample_id AS VARCHAR)) AS digest FROM c""",
)
def scalar_functions(spark, sf):
    p = F.col("p_temporal")
    return rounded(
        src.pair(spark, sf).select(
            "sample_id",
            s.sigmoid((p - 0.5) * 100).alias("sigmoid"),
            s.logit(p).alias("logit"),
            s.binary_entropy("p_spectral").alias("entropy"),
            s.margin(p).alias("margin"),
            s.confidence(p).alias("confidence"),
            s.same_side(p, "p_spectral").alias("agreement"),
            s.wrap_degrees(p * 1000 - 400).alias("degrees"),
            F.log1p("p_spectral").alias("log1p"),
            F.signum(p - F.col("p_spectral")).alias("sgn"),
            F.format_string("train:%08d", "sample_id").alias("padded"),
            F.sha2(F.col("sample_id").cast("string"), 256).alias("digest"),
        )
    )


@query(
    "json_records",
    """SELECT l_returnflag, round(avg(l_tax), 6) AS mean_tax, count(*) AS n, '[' || CAST(min(l_quantity) AS VARCHAR) || ', ' || CAST(max(l_quantity) AS VARCHAR) || ']' AS bounds,
      min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""",
)
def json_records(spark, sf):
    """A metric record encoded as JSON per row, decoded again, and a bounds string parsed."""
    g = src.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.to_json(F.struct(F.avg("l_tax").alias("mean_tax"), F.count(F.lit(1)).alias("n"))).alias("record"),
        F.concat(F.lit("["), F.min("l_quantity").cast("string"), F.lit(", "), F.max("l_quantity").cast("string"), F.lit("]")).alias("bounds"),
    )
    back = F.from_json("record", "mean_tax double, n bigint")
    parsed = F.transform(F.split(F.regexp_replace("bounds", r"[\[\]]", ""), ","), lambda x: F.trim(x).cast("double"))
    return rounded(
        g.select(
            "l_returnflag", back["mean_tax"].alias("mean_tax"), back["n"].alias("n"), "bounds",
            parsed[0].alias("low"), parsed[1].alias("high"),
        )
    )


@query(
    "text_keys",
    """SELECT o_orderkey, regexp_replace(o_orderpriority, '^[0-9]-', '') AS priority, contains(o_orderpriority, 'HIGH') AS high,
      split_part(o_orderpriority, '-', 1) || '/' || o_orderstatus AS pattern FROM orders""",
)
def text_keys(spark, sf):
    o = src.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("priority"),
        F.col("o_orderpriority").contains("HIGH").alias("high"),
        F.array_join(F.array(F.split("o_orderpriority", "-")[0], F.col("o_orderstatus")), "/").alias("pattern"),
    )


@query(
    "best_listing",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def best_listing(spark, sf):
    """Best-20 report: a bounded top-k, merged from per-task heaps."""
    o = src.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
