"""Array signals: windows, moments, features, references, events, spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigloom.functions import arrays as ar
from sigloom.operators import pulses as pu
from sigloom.operators import signals as sg
from sigloom.operators import spectra as sx
from sigloom.plans import inputs as src
from sigloom.plans.registry import query, round_to, rounded
from sigloom.session import cut_lineage
from sigloom.sources import signals as sources

SPEC = sg.WindowSpec(16, 10)


def sig(spark, sf):
    return src.signals(spark, sf).select("sample_id", "values")


@query(
    "windows",
    f"""WITH {src.SIGNALS}, st AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s FROM (SELECT DISTINCT least(k*10, 48) AS s FROM range(6) r(k)))
    SELECT sample_id, CAST(w AS INT) AS window_index, CAST(s AS INT) AS start, round(sum(v),6) AS total, count(*) AS n FROM samples JOIN st ON i >= s AND i < s + 16 GROUP BY ALL""",
)
def windows(spark, sf):
    w = sg.windows(sig(spark, sf), SPEC)
    return rounded(
        w.select("sample_id", "window_index", "start", ar.array_sum("values").alias("total"), F.size("values").cast("bigint").alias("n"))
    )


@query(
    "window_map",
    f"""WITH {src.SIGNALS} SELECT sample_id AS parent_id, id_measurement, 'train' AS split, CAST(w AS INT) AS window_index FROM signals, range(6) r(w)""",
)
def window_map(spark, sf):
    m = src.signals(spark, sf).select("sample_id", "id_measurement", F.lit("train").alias("split"))
    return sg.window_map(m, len(SPEC.starts(64)))


WSCORES = f"""{src.SIGNALS}, st AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s FROM (SELECT DISTINCT least(k*4, 56) AS s FROM range(15) r(k))),
   ws AS (SELECT sample_id, w, least(greatest(round(0.5 + sum(v), 6), 0), 1) AS p FROM samples JOIN st ON i >= s AND i < s + 8 GROUP BY ALL),
   rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, w) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM ws)"""


def window_scores(spark, sf):
    w = sg.windows(sig(spark, sf), sg.WindowSpec(8, 4))
    p = F.least(F.greatest(round_to(F.lit(0.5) + ar.array_sum("values")), F.lit(0.0)), F.lit(1.0))
    return w.select("sample_id", "window_index", p.alias("probability"))


@query(
    "window_score_summary",
    f"""WITH {WSCORES} SELECT sample_id, count(*) AS windows, round(max(p),6) AS max_probability, round(avg(p),6) AS mean_probability,
      round(avg(CASE WHEN r <= greatest(1, ceil(0.3*n)) THEN p END),6) AS top_k_mean_probability, round(stddev_pop(p),6) AS std_probability,
      round(avg(CAST(p>=0.5 AS INT)),6) AS fraction_high_confidence, round(max(CASE WHEN r=1 THEN p END)-max(CASE WHEN r=2 THEN p END),6) AS top1_top2_gap
     FROM rk GROUP BY sample_id""",
)
def window_score_summary(spark, sf):
    return rounded(sg.window_score_summary(window_scores(spark, sf), 0.3))


@query(
    "top_k_mean",
    f"""WITH {src.SIGNALS}, r AS (SELECT sample_id, v, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC) AS r FROM samples)
    SELECT sample_id, round(avg(v),6) AS top_mean, round(max(v),6) AS top_one FROM r WHERE r <= ceil(0.1*64) GROUP BY sample_id""",
)
def top_k_mean(spark, sf):
    return rounded(sig(spark, sf).select("sample_id", ar.top_k_mean("values", 0.1).alias("top_mean"), F.array_max("values").alias("top_one")))


@query(
    "half_top_k",
    f"""WITH {WSCORES}, h AS (SELECT sample_id, w, p, CAST(w >= 7 AS INT) AS half FROM ws), q AS (SELECT *, row_number() OVER (PARTITION BY sample_id, half ORDER BY p DESC, w) AS r FROM h),
      m AS (SELECT sample_id, half, avg(p) AS p FROM q WHERE r <= 3 GROUP BY ALL)
    SELECT sample_id, round(avg(p),9) AS probability FROM m GROUP BY sample_id""",
)
def half_top_k(spark, sf):
    s = window_scores(spark, sf).withColumn("half", (F.col("window_index") >= 7).cast("int")).withColumnRenamed("window_index", "rank")
    return rounded(sg.half_top_k(s, capacity=30, fraction=0.1), 9)


@query(
    "energy_concentration",
    f"""WITH {src.SIGNALS}, r AS (SELECT sample_id, v*v AS e, row_number() OVER (PARTITION BY sample_id ORDER BY v*v DESC) AS r FROM samples)
    SELECT sample_id, round(sum(e) FILTER (r <= 6)/sum(e),6) AS share FROM r GROUP BY sample_id""",
)
def energy_concentration(spark, sf):
    e = sig(spark, sf).withColumn("energy", F.transform("values", lambda x: x * x))
    return rounded(e.select("sample_id", sg.energy_concentration("energy").alias("share")))


@query(
    "fit_standardizer",
    f"""WITH {src.SIGNALS} SELECT CAST(i AS INT) AS pos, count(*) AS n, round(avg(v),6) AS mean, round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END,6) AS std
     FROM samples WHERE split='train' GROUP BY i""",
)
def fit_standardizer(spark, sf):
    return rounded(sg.fit_standardizer(src.signals(spark, sf).where("split = 'train'")))


@query(
    "fit_scalar_standardizer",
    f"""WITH {src.SIGNALS} SELECT count(*) AS n, round(avg(v),6) AS mean, round(sqrt(greatest(var_pop(v),1e-12)),6) AS std FROM samples WHERE split='train'""",
)
def fit_scalar_standardizer(spark, sf):
    return rounded(sg.fit_scalar_standardizer(src.signals(spark, sf).where("split = 'train'")))


@query(
    "standardize",
    f"""WITH {src.SIGNALS}, m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS std FROM samples WHERE split='train' GROUP BY i)
    SELECT sample_id, CAST(s.i AS INT) AS pos, round((v-mean)/std,6) AS z FROM samples s JOIN m ON s.i = m.i""",
)
def standardize(spark, sf):
    s = src.signals(spark, sf)
    z = sg.standardize(s.select("sample_id", "values"), sg.fit_standardizer(s.where("split = 'train'")))
    return rounded(z.select("sample_id", F.posexplode("values").alias("pos", "z")))


MOMENTS = """mo AS (SELECT sample_id, avg(v) AS mu, sqrt(avg(v*v)) AS rms, max(abs(v)) AS pk, stddev_pop(v) AS sd, max(v) AS hi, min(v) AS lo, sum(v*v) AS e2 FROM samples GROUP BY 1),
   ce AS (SELECT s.sample_id, avg(power(v-mu,3)) AS m3, avg(power(v-mu,4)) AS m4, avg(power(v-mu,2)) AS m2 FROM samples s JOIN mo USING (sample_id) GROUP BY 1)"""
DFT = """dft AS (SELECT sample_id, k, sum(v*cos(2*pi()*k*i/64)) AS re, sum(v*sin(2*pi()*k*i/64)) AS im FROM samples, range(33) r(k) GROUP BY ALL)"""


@query(
    "signal_features",
    f"""WITH {src.SIGNALS}, {MOMENTS}, {DFT}, pw AS (SELECT sample_id, k, power(sqrt(re*re+im*im)+1e-12,2) AS p FROM dft),
      tt AS (SELECT sample_id, sum(p) AS t FROM pw GROUP BY 1), sp AS (SELECT sample_id, sum(p*k/32)/max(t) AS c, -sum(p/t*ln(p/t))/ln(33) AS h, sum(p) FILTER (k >= 8)/max(t) AS hr FROM pw JOIN tt USING (sample_id) GROUP BY 1)
    SELECT sample_id, round(rms,6) AS rms, round(pk,6) AS peak_abs, round(rms*rms,6) AS energy, round(sd+1e-8,6) AS std, round(m3/power(sd+1e-8,3),6) AS skewness,
      round(m4/power(sd+1e-8,4)-3,6) AS kurtosis, round(pk/(rms+1e-8),6) AS crest_factor, round(c,6) AS spectral_centroid, round(h,6) AS spectral_entropy, round(hr,6) AS high_frequency_ratio
    FROM mo JOIN ce USING (sample_id) JOIN sp USING (sample_id)""",
)
def signal_features(spark, sf):
    return rounded(sg.signal_features(sig(spark, sf)))


@query(
    "signal_quality",
    f"""WITH {src.SIGNALS}, {MOMENTS}, d AS (SELECT sample_id, v - lag(v) OVER (PARTITION BY sample_id ORDER BY i) AS d FROM samples),
      md AS (SELECT sample_id, median(d) AS c FROM d WHERE d IS NOT NULL GROUP BY 1), ro AS (SELECT d.sample_id, median(abs(d-c))*1.4826/sqrt(2) AS rn FROM d JOIN md USING (sample_id) WHERE d IS NOT NULL GROUP BY 1)
    SELECT sample_id, round(sqrt(rms*rms+1e-12),6) AS rms, round(pk,6) AS peak, round(hi-lo,6) AS peak_to_peak, round(pk/greatest(sqrt(rms*rms+1e-12),1e-8),6) AS crest, round(e2,6) AS energy, round(sd,6) AS std,
      round(63.0/(62*61)*(65*(m4/(m2*m2)-3)+6),6) AS kurtosis, round(sqrt(64.0*63)/62*m3/power(m2,1.5),6) AS skewness, round(rn,6) AS robust_noise
    FROM mo JOIN ce USING (sample_id) JOIN ro USING (sample_id)""",
)
def signal_quality(spark, sf):
    return rounded(sg.signal_quality(sig(spark, sf)))


@query(
    "block_embedding",
    f"""WITH {src.SIGNALS}, b AS (SELECT sample_id, i // 4 AS b, avg(v) AS m, stddev_pop(v) AS s FROM samples GROUP BY ALL)
    SELECT sample_id, CAST(b AS INT) AS pos, round(m,6) AS value FROM b UNION ALL SELECT sample_id, CAST(b+16 AS INT), round(s,6) FROM b""",
)
def block_embedding(spark, sf):
    e = sg.block_embedding(sig(spark, sf), 16)
    return rounded(e.select("sample_id", F.posexplode("embedding").alias("pos", "value")))


@query(
    "scale_frequency",
    """SELECT CAST(p_partkey AS BIGINT) AS part, round(40000000.0*6/(2*pi())/(1.5+p_size),3) AS hz, p_size/40000000.0 AS seconds FROM part""",
)
def scale_frequency(spark, sf):
    p = src.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("part"),
        F.round(sg.scale_frequency(F.lit(1.5) + F.col("p_size"), 40e6), 3).alias("hz"),
        (F.col("p_size") / 40e6).alias("seconds"),
    )


@query(
    "resample",
    f"""WITH {src.SIGNALS}, {DFT}, o AS (SELECT sample_id, j, sum(CASE WHEN k IN (0,16) THEN 1 ELSE 2 END * (CASE WHEN k = 16 THEN 2 ELSE 1 END) * (re*cos(2*pi()*k*j/32) + CASE WHEN k = 16 THEN 0 ELSE im*sin(2*pi()*k*j/32) END))/32*(32/64.0) AS v
       FROM dft, range(32) q(j) WHERE k <= 16 GROUP BY ALL)
    SELECT sample_id, CAST(j AS INT) AS pos, round(v,6) AS value FROM o""",
)
def resample(spark, sf):
    r = sg.resample(sig(spark, sf), 32)
    return rounded(r.select("sample_id", F.posexplode("values").alias("pos", "value")))


CENTROIDS = f"""{src.SIGNALS}, f AS (SELECT DISTINCT fold FROM samples), c AS (SELECT f.fold, target, i, avg(v) AS m FROM samples s, f WHERE s.fold <> f.fold GROUP BY ALL),
   d AS (SELECT s.sample_id, c.target, sqrt(sum((v-m)*(v-m))) AS d FROM samples s JOIN c ON s.fold = c.fold AND s.i = c.i GROUP BY ALL)"""


@query(
    "oof_centroid_distance",
    f"""WITH {CENTROIDS} SELECT sample_id, round(max(d) FILTER (target=0),6) AS distance_0, round(max(d) FILTER (target=1),6) AS distance_1 FROM d GROUP BY 1""",
)
def oof_centroid_distance(spark, sf):
    s = src.signals(spark, sf)
    c = sg.fit_centroids(s, "values", fold="fold")
    d = sg.centroid_distance(s, c, "values", fold="fold")
    return rounded(d.select("sample_id", "distance_0", "distance_1"))


@query(
    "centroid_distance",
    f"""WITH {src.SIGNALS}, c AS (SELECT target, i, avg(v) AS m FROM samples WHERE split='train' GROUP BY ALL),
      d AS (SELECT s.sample_id, c.target, sqrt(avg((v-m)*(v-m))) AS d FROM samples s JOIN c ON s.i = c.i GROUP BY ALL)
    SELECT sample_id, round(max(d) FILTER (target=0),6) AS distance_0, round(max(d) FILTER (target=1),6) AS distance_1 FROM d GROUP BY 1""",
)
def centroid_distance(spark, sf):
    s = src.signals(spark, sf)
    c = sg.fit_centroids(s.where("split = 'train'"), "values")
    return rounded(sg.centroid_distance(s, c, "values", kind="rms").select("sample_id", "distance_0", "distance_1"))


# Sources ------------------------------------------------------------------------------


@query(
    "read_array_signals",
    """SELECT 'train:' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS sample_id, label, CAST(len(embedding) AS INT) AS n, round(list_sum(embedding::DOUBLE[]),6) AS total FROM embeddings""",
)
def read_array_signals(spark, sf):
    s = sources.read_array_signals(spark, f"{sf}/embeddings.parquet", 64, "vec_id", "embedding", "train")
    return rounded(s.select("sample_id", "label", "n", ar.array_sum("values").alias("total")))


@query(
    "wide_to_signals",
    """WITH r AS (SELECT row_number() OVER () - 1 AS i, l_quantity, l_tax FROM lineitem), u AS (SELECT 'l_quantity' AS sample_id, i, l_quantity AS v FROM r UNION ALL SELECT 'l_tax', i, l_tax FROM r)
    SELECT sample_id, CAST(i // 512 AS BIGINT) AS chunk, CAST(count(*) AS INT) AS n, round(sum(v),4) AS total, round(arg_min(v, i),6) AS first_value, round(arg_max(v, i),6) AS last_value FROM u GROUP BY ALL""",
)
def wide_to_signals(spark, sf):
    """Column-per-signal Parquet -> chunked array rows in sample order."""
    s = sources.read_wide_signals(spark, f"{sf}/lineitem.parquet", ["l_quantity", "l_tax"], chunk=512)
    return s.select(
        "sample_id", "chunk", "n", F.round(ar.array_sum("values"), 4).alias("total"),
        round_to(F.get("values", F.lit(0))).alias("first_value"), round_to(F.get("values", F.col("n") - 1)).alias("last_value"),
    )


@query(
    "profile_signals",
    f"""WITH {src.SIGNALS}, f AS (SELECT sample_id FROM signals ORDER BY sample_id LIMIT 20)
    SELECT sample_id, CAST(count(*) AS INT) AS n, true AS finite, round(min(v),6) AS minimum, round(max(v),6) AS maximum, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, count(*)/1000.0::DOUBLE AS seconds
    FROM samples WHERE sample_id IN (SELECT sample_id FROM f) GROUP BY 1""",
)
def profile_signals(spark, sf):
    """Bounded audit: the first 20 signals only, by definition of the operator."""
    return rounded(sources.profile_signals(sig(spark, sf), 20, 1000.0))


# Cycle references ---------------------------------------------------------------------

POLICY = pu.PulsePolicy(length=64, rate_hz=3200.0, smoothing=5, alpha=10.0, beta=1.0, knee_smoothing=9, min_distance=1,
                        min_pulses=3, pulses_per_half=6, short_segment=4, long_segment=8)


def smooth_sql(left: int, right: int) -> str:
    return f"""sm AS (SELECT a.sample_id, a.i, avg(b.v) AS s FROM (SELECT sample_id, i, unnest(generate_series(i-{left}, i+{right})) AS j FROM samples) a
      JOIN samples b ON a.sample_id = b.sample_id AND b.i = greatest(0, least(63, a.j)) GROUP BY ALL)"""


@query(
    "moving_average",
    f"""WITH {src.SIGNALS}, {smooth_sql(2, 1)} SELECT sample_id, CAST(i AS INT) AS pos, round(s,6) AS value FROM sm""",
)
def moving_average(spark, sf):
    m = sig(spark, sf).select("sample_id", F.posexplode(pu.moving_average("values", 4)).alias("pos", "value"))
    return rounded(m)


@query(
    "zero_crossings",
    f"""WITH {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER (PARTITION BY sample_id ORDER BY i) AS u FROM samples)
    SELECT sample_id, CAST(i AS INT) AS pos, CASE WHEN v > 0 THEN 'rising' ELSE 'falling' END AS kind FROM l WHERE (u <= 0 AND v > 0) OR (u >= 0 AND v < 0)""",
)
def zero_crossings(spark, sf):
    s = sig(spark, sf)
    up = s.select("sample_id", F.explode(ar.zero_crossings("values", True)).alias("pos"), F.lit("rising").alias("kind"))
    down = s.select("sample_id", F.explode(ar.zero_crossings("values", False)).alias("pos"), F.lit("falling").alias("kind"))
    return up.unionByName(down)


def reference_sql(centred: bool) -> str:
    centre = "s - median(s) OVER (PARTITION BY sample_id)" if centred else "s"
    return f"""{smooth_sql(2, 2)}, ce AS (SELECT sample_id, i, {centre} AS c FROM sm),
     lg AS (SELECT sample_id, i, c, lag(c) OVER (PARTITION BY sample_id ORDER BY i) AS b FROM ce),
     ri AS (SELECT sample_id, i FROM lg WHERE b <= 0 AND c > 0), fa AS (SELECT sample_id, i FROM lg WHERE b >= 0 AND c < 0),
     pr AS (SELECT ri.sample_id, ri.i AS o, fa.i AS p, CASE WHEN fa.i > ri.i THEN fa.i - ri.i ELSE fa.i + 64 - ri.i END AS sep FROM ri JOIN fa USING (sample_id)),
     bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(sep-32), o, p) AS rn FROM pr) WHERE rn = 1),
     fr AS (SELECT sample_id, min(i) AS r0 FROM ri GROUP BY 1), ff AS (SELECT sample_id, min(i) AS f0 FROM fa GROUP BY 1),
     al AS (SELECT g.sample_id, r0, f0, o, p, sep FROM signals g LEFT JOIN fr USING (sample_id) LEFT JOIN ff USING (sample_id) LEFT JOIN bp USING (sample_id))"""


CURRENT = """cur AS (SELECT sample_id, (r0 IS NOT NULL OR f0 IS NOT NULL) AS success,
   CAST(CASE WHEN r0 IS NULL THEN (f0+32)%64 WHEN f0 IS NULL THEN r0 WHEN abs(sep-32) > 8 THEN r0 ELSE o END AS INT) AS origin,
   CAST(CASE WHEN r0 IS NULL THEN f0 WHEN f0 IS NULL THEN (r0+32)%64 WHEN abs(sep-32) > 8 THEN (r0+32)%64 ELSE p END AS INT) AS opposite,
   (r0 IS NULL OR f0 IS NULL OR abs(sep-32) > 8) AS inferred FROM al)"""


@query("cycle_reference", f"WITH {src.SIGNALS}, {reference_sql(True)}, {CURRENT} SELECT * FROM cur")
def cycle_reference(spark, sf):
    s = sig(spark, sf).select("sample_id", pu.cycle_reference("values", POLICY).alias("c"))
    return s.select("sample_id", "c.success", "c.origin", "c.opposite", "c.inferred")


@query(
    "strict_reference",
    f"""WITH {src.SIGNALS}, {reference_sql(False)} SELECT sample_id, coalesce(abs(sep-32) <= 8, false) AS success,
      CAST(CASE WHEN abs(sep-32) <= 8 THEN o END AS INT) AS origin, CAST(CASE WHEN abs(sep-32) <= 8 THEN p END AS INT) AS opposite FROM al""",
)
def strict_reference(spark, sf):
    s = sig(spark, sf).select("sample_id", pu.cycle_reference("values", POLICY, strict=True).alias("c"))
    return s.select("sample_id", "c.success", "c.origin", "c.opposite")


def degrees_sql(a: str, b: str) -> str:
    x = f"(({b} - {a}) / 64.0::DOUBLE * 360 + 180)"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({x} - 360 * floor({x} / 360) - 180) END"


# The three references of every signal: landmarks of the centred and of the raw curve, and the
# sinusoid of the frequency with the least error, from its 3x3 normal equations.
RECORDS = f"""{reference_sql(True)}, {CURRENT},
  stc AS (WITH {reference_sql(False)} SELECT sample_id, CASE WHEN abs(sep-32) <= 8 THEN o END AS origin FROM al),
  ph AS (SELECT f, i, sin(2*pi()*f*i/3200) AS u, cos(2*pi()*f*i/3200) AS w FROM (VALUES (50.0::DOUBLE), (60.0::DOUBLE)) t(f), range(64) r(i)),
  mo AS (SELECT sample_id, f, sum(u*u) AS a, sum(u*w) AS b, sum(u) AS c, sum(w*w) AS d, sum(w) AS e, 64.0::DOUBLE AS n, sum(u*s) AS p, sum(w*s) AS q, sum(s) AS r, sum(s*s) AS yy
    FROM sm JOIN ph ON ph.i = sm.i GROUP BY sample_id, f),
  de AS (SELECT *, a*(d*n-e*e) - b*(b*n-c*e) + c*(b*e-c*d) AS det FROM mo),
  so AS (SELECT sample_id, f, ((d*n-e*e)*p + (c*e-b*n)*q + (b*e-c*d)*r)/det AS x, ((c*e-b*n)*p + (a*n-c*c)*q + (b*c-a*e)*r)/det AS y, ((b*e-c*d)*p + (b*c-a*e)*q + (a*d-b*b)*r)/det AS z, p, q, r, yy FROM de),
  be AS (SELECT sample_id, arg_min(f, (yy - x*p - y*q - z*r, f)) AS f FROM so GROUP BY 1),
  wv AS (SELECT so.sample_id, ph.i, x*u + y*w AS v FROM so JOIN be ON be.sample_id = so.sample_id AND be.f = so.f JOIN ph ON ph.f = so.f),
  cr AS (SELECT sample_id, i, v, lag(v) OVER (PARTITION BY sample_id ORDER BY i) AS b FROM wv),
  si AS (SELECT sample_id, min(i) - 1 AS origin FROM cr WHERE b <= 0 AND v > 0 GROUP BY 1),
  og AS (SELECT g.sample_id, g.id_measurement, CASE WHEN cur.success THEN cur.origin END AS o1, stc.origin AS o2, si.origin AS o3
    FROM signals g LEFT JOIN cur USING (sample_id) LEFT JOIN stc USING (sample_id) LEFT JOIN si USING (sample_id)),
  rec AS (SELECT sample_id, id_measurement, CAST(o1 IS NOT NULL AS INT) AS s1, CAST(o2 IS NOT NULL AS INT) AS s2, CAST(o3 IS NOT NULL AS INT) AS s3,
    {degrees_sql('o1', 'o2')} AS d12, {degrees_sql('o1', 'o3')} AS d13, {degrees_sql('o2', 'o3')} AS d23 FROM og)"""


@query(
    "alignment_records",
    f"""WITH {src.SIGNALS}, {RECORDS} SELECT sample_id, s1 AS current_success, s2 AS strict_success, s3 AS sinusoid_success,
      round(d12,6) AS current_strict_degrees, round(d13,6) AS current_sinusoid_degrees, round(d23,6) AS strict_sinusoid_degrees FROM rec""",
)
def alignment_records(spark, sf):
    a = pu.alignment_records(src.signals(spark, sf).select("sample_id", "id_measurement", "values"), POLICY, step=1)
    return rounded(a.select("sample_id", "current_success", "strict_success", "sinusoid_success", "current_strict_degrees", "current_sinusoid_degrees", "strict_sinusoid_degrees"))


@query(
    "alignment_disagreement",
    f"""WITH {src.SIGNALS}, {reference_sql(True)}, {CURRENT} SELECT sample_id, round(abs((((opposite-origin)/64.0*360+180) - 360*floor(((opposite-origin)/64.0*360+180)/360)) - 180),6) AS degrees FROM cur WHERE success""",
)
def alignment_disagreement(spark, sf):
    """Wrapped angle between the two landmarks of the centred reference."""
    s = sig(spark, sf).select("sample_id", pu.cycle_reference("values", POLICY).alias("c")).where("c.success")
    other = F.struct(F.col("c.success").alias("success"), F.col("c.opposite").alias("origin"))
    return rounded(s.select("sample_id", pu.degrees_apart(F.col("c"), other, 64).alias("degrees")))


@query(
    "alignment_summary",
    f"""WITH {src.SIGNALS}, {RECORDS}, g AS (SELECT id_measurement, sum(s1) AS hits FROM rec GROUP BY 1),
      t AS (SELECT avg(s1) AS r1, avg(s2) AS r2, avg(s3) AS r3, avg(s1*s2*s3) AS r4, (SELECT avg(CAST(hits = 3 AS INT)) FROM g) AS gr,
        (SELECT median(d) FROM (SELECT unnest([d12, d13, d23]) AS d FROM rec) WHERE d IS NOT NULL) AS md FROM rec)
    SELECT round(r1,6) AS current_rate, round(r2,6) AS strict_rate, round(r3,6) AS sinusoid_rate, round(r4,6) AS all_method_rate, round(gr,6) AS complete_group_rate, round(md,6) AS median_disagreement,
      CASE WHEN least(r1, r2, r3, gr) >= 0.95 AND md <= 20 THEN 'VALID' WHEN least(r1, r2, r3) >= 0.5 THEN 'PARTIAL/AMBIGUOUS' ELSE 'INVALID' END AS status FROM t""",
)
def alignment_summary(spark, sf):
    from sigloom.operators.audits import alignment_summary as summarize

    a = pu.alignment_records(src.signals(spark, sf).select("sample_id", "id_measurement", "values"), POLICY, step=1)
    return rounded(summarize(cut_lineage(a)))


@query(
    "roll",
    f"""WITH {src.SIGNALS}, {reference_sql(True)}, {CURRENT} SELECT s.sample_id, CAST((i - origin + 64) % 64 AS INT) AS pos, v AS value FROM samples s JOIN cur USING (sample_id)""",
)
def roll(spark, sf):
    s = sig(spark, sf).withColumn("c", pu.cycle_reference("values", POLICY)).where("c.success")
    return s.select("sample_id", F.posexplode(ar.rotate("values", "c.origin")).alias("pos", "value"))


ROLLED = f"""{reference_sql(True)}, {CURRENT}, ro AS (SELECT s.sample_id, (i - origin + 64) % 64 AS i, v FROM samples s JOIN cur USING (sample_id) WHERE success),
  fl AS (SELECT a.sample_id, a.i, a.v - sum(0.1*power(0.9, a.i-b.i)*b.v) AS x, a.v FROM ro a JOIN ro b ON a.sample_id=b.sample_id AND b.i <= a.i GROUP BY a.sample_id, a.i, a.v)"""


@query("flatten", f"WITH {src.SIGNALS}, {ROLLED} SELECT sample_id, CAST(i AS INT) AS pos, round(x,6) AS value FROM fl")
def flatten(spark, sf):
    d = pu.detect_pulses(sig(spark, sf), POLICY)
    return rounded(d.select("sample_id", F.posexplode("flattened").alias("pos", "value")))


@query(
    "local_maxima",
    f"""WITH {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i))
    SELECT sample_id, CAST(i AS INT) AS pos, round(v,6) AS score FROM l WHERE v > a AND v > b""",
)
def local_maxima(spark, sf):
    p = sig(spark, sf).select("sample_id", F.explode(pu.find_peaks("values")).alias("p"))
    return rounded(p.select("sample_id", "p.pos", "p.score"))


PEAKS_SQL = f"""WITH RECURSIVE {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
g AS (SELECT sample_id, list({{'i': i, 'v': v}} ORDER BY v DESC, i DESC) AS rest, CAST([] AS STRUCT(i BIGINT, v DOUBLE)[]) AS kept FROM l WHERE v > a AND v > b GROUP BY sample_id
  UNION ALL SELECT sample_id, list_filter(rest, lambda x: abs(x.i - rest[1].i) >= 5), list_append(kept, rest[1]) FROM g WHERE len(rest) > 0),
k AS (SELECT sample_id, k.i AS p, k.v AS h FROM (SELECT sample_id, unnest(kept) AS k FROM g WHERE len(rest) = 0)),
m AS (SELECT sample_id, median(abs(v - c)) * 1.4826 AS noise FROM samples JOIN (SELECT sample_id, median(v) AS c FROM samples GROUP BY 1) USING (sample_id) GROUP BY 1),
e AS (SELECT k.sample_id, p, h, coalesce(max(i) FILTER (i < p AND v > h), -1) AS lo, coalesce(min(i) FILTER (i > p AND v > h), 1000000) AS hi FROM k JOIN samples s ON s.sample_id = k.sample_id GROUP BY k.sample_id, p, h),
q AS (SELECT e.sample_id, p, h, h - greatest(min(v) FILTER (i > lo AND i <= p), min(v) FILTER (i < hi AND i >= p)) AS prominence FROM e JOIN samples s ON s.sample_id = e.sample_id GROUP BY e.sample_id, p, h)
SELECT q.sample_id, CAST(p AS INT) AS pos, round(h,6) AS score FROM q JOIN m USING (sample_id) WHERE prominence >= noise"""


@query("find_peaks", PEAKS_SQL)
def find_peaks(spark, sf):
    """Greedy spacing, then prominence against robust noise."""
    p = sig(spark, sf).select("sample_id", F.explode(pu.find_peaks("values", 5, 1.0)).alias("p"))
    return rounded(p.select("sample_id", "p.pos", "p.score"))


EVENTS = f"""{ROLLED}, ab AS (SELECT sample_id, i, abs(x) AS h, v, lag(abs(x)) OVER w AS a, lead(abs(x)) OVER w AS b FROM fl WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
  ev AS (SELECT sample_id, CAST(i >= 32 AS INT) AS half, i AS pos, h AS amplitude, sign(v) AS sgn, row_number() OVER (PARTITION BY sample_id, i >= 32 ORDER BY h DESC, i) AS rank,
     count(*) OVER (PARTITION BY sample_id, i >= 32) AS n FROM ab WHERE h > a AND h > b),
  wd AS (SELECT *, least(9, n) AS w FROM ev),
  sm2 AS (SELECT a.sample_id, a.half, a.rank, a.n, avg(ln(1+b.amplitude)) AS s FROM (SELECT *, unnest(generate_series(rank - w//2, rank + w - w//2 - 1)) AS j FROM wd) a
     JOIN ev b ON a.sample_id=b.sample_id AND a.half=b.half AND b.rank = greatest(1, least(a.n, a.j)) GROUP BY ALL),
  g1 AS (SELECT *, CASE WHEN rank=1 THEN lead(s) OVER q - s WHEN rank=n THEN s - lag(s) OVER q ELSE (lead(s) OVER q - lag(s) OVER q)/2 END AS g FROM sm2 WINDOW q AS (PARTITION BY sample_id, half ORDER BY rank)),
  g2 AS (SELECT *, abs(CASE WHEN rank=1 THEN lead(g) OVER q - g WHEN rank=n THEN g - lag(g) OVER q ELSE (lead(g) OVER q - lag(g) OVER q)/2 END) AS b FROM g1 WINDOW q AS (PARTITION BY sample_id, half ORDER BY rank)),
  kn AS (SELECT sample_id, half, max(n) AS n, CASE WHEN max(n) < 3 THEN max(n) ELSE least(max(n), greatest(3, arg_min(rank, (-b, rank)) + 1)) END AS k FROM g2 GROUP BY ALL),
  sel AS (SELECT ev.* FROM ev JOIN kn USING (sample_id, half) WHERE rank <= k)"""
# The same with the tie rule: of bends that are equal up to rounding (``kernels.BEND_TIE``) the first rank counts.
TIED_EVENTS = EVENTS.replace("arg_min(rank, (-b, rank)) + 1", "min(rank) FILTER (b >= top - 1e-12) + 1").replace(
    "FROM g2 GROUP BY ALL", "FROM (SELECT *, max(b) OVER (PARTITION BY sample_id, half) AS top FROM g2) GROUP BY ALL"
)


def candidates(spark, sf):
    """Every local maximum of the flattened signal as an event row, unranked."""
    rows = pu.pulse_candidates(sig(spark, sf), POLICY)
    return rows.select("sample_id", (F.col("pos") >= 32).cast("int").alias("half"), "pos", "amplitude")


@query(
    "rank_events",
    f"WITH {src.SIGNALS}, {EVENTS} SELECT sample_id, half, CAST(pos AS INT) AS pos, round(amplitude,6) AS amplitude, CAST(rank AS INT) AS rank FROM ev",
)
def rank_events(spark, sf):
    return rounded(pu.rank_events(candidates(spark, sf)))


@query(
    "top_events",
    """SELECT event_id, user_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 6""",
)
def top_events(spark, sf):
    e = src.table(spark, sf, "events").select("event_id", "user_id", "value")
    return pu.top_events(e, 6, ["user_id"], "value", "event_id").select("event_id", "user_id", "rank")


@query("knee_counts", f"WITH {src.SIGNALS}, {TIED_EVENTS} SELECT sample_id, half, n AS candidates, CAST(k AS BIGINT) AS selected FROM kn")
def knee_counts(spark, sf):
    return pu.knee_counts(candidates(spark, sf), 9, 3)


@query(
    "detect_pulses",
    f"WITH {src.SIGNALS}, {EVENTS} SELECT sample_id, half, CAST(rank AS INT) AS rank, CAST(pos AS INT) AS pos, round(amplitude,6) AS amplitude, CAST(sgn AS INT) AS sign FROM sel",
)
def detect_pulses(spark, sf):
    return rounded(pu.pulse_events(pu.detect_pulses(sig(spark, sf), POLICY)))


@query(
    "event_spacing",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS}, g AS (SELECT sample_id, pos - lag(pos) OVER (PARTITION BY sample_id ORDER BY pos) AS d FROM sel)
    SELECT sample_id, count(*) AS events, round(coalesce(median(d),0),6) AS spacing_median, round(coalesce(quantile_cont(d,0.1),0),6) AS spacing_p10 FROM g GROUP BY 1""",
)
def event_spacing(spark, sf):
    return rounded(pu.event_spacing(pu.pulse_events(pu.detect_pulses(sig(spark, sf), POLICY))))


@query(
    "coverage",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS}, c AS (SELECT g.sample_id, count(pos) FILTER (half=0) AS a, count(pos) FILTER (half=1) AS b FROM signals g LEFT JOIN sel USING (sample_id) GROUP BY 1)
    SELECT count(*) AS n_signals, 6 AS capacity, count(*) FILTER (least(a,b)>0) AS signals_with_both_halves, count(*) FILTER (least(a,b)>=8) AS signals_with_eight_each_half,
      round(avg((a+b)/2),6) AS mean_per_half, min(least(a,b)) AS minimum_per_half, count(*) FILTER (least(a,b)=0) = 0 AS coverage_ok FROM c""",
)
def coverage(spark, sf):
    s = sig(spark, sf)
    return rounded(pu.coverage(pu.pulse_events(pu.detect_pulses(s, POLICY)), s, 6))


@query(
    "event_localization",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS} SELECT sample_id, count(*) FILTER (half=0) AS first_half, count(*) FILTER (half=1) AS second_half, CAST(min(pos) AS INT) AS first_pos, CAST(max(pos) AS INT) AS last_pos FROM sel GROUP BY 1""",
)
def event_localization(spark, sf):
    return pu.event_localization(pu.pulse_events(pu.detect_pulses(sig(spark, sf), POLICY)))


BAG = """bag AS (SELECT * FROM sel WHERE rank <= 6)"""


@query(
    "pulse_bag",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS}, {BAG}, sg AS (SELECT b.sample_id, b.half, b.rank, b.pos, o, (b.pos + o + 64) % 64 AS j FROM bag b, range(-4, 4) r(o))
    SELECT sg.sample_id, sg.half, CAST(sg.rank AS INT) AS rank, CAST(sg.pos AS INT) AS pos, round(sum(v) FILTER (o >= -2 AND o < 2),6) AS short_total, round(sum(v*(o+5)),6) AS long_weighted
    FROM sg JOIN ro ON ro.sample_id = sg.sample_id AND ro.i = sg.j GROUP BY ALL""",
)
def pulse_bag(spark, sf):
    bag = pu.pulse_bag(pu.detect_pulses(sig(spark, sf), POLICY), POLICY)
    ramp = F.zip_with("long_segment", F.array(*[F.lit(float(k)) for k in range(1, 9)]), lambda x, w: x * w)
    return rounded(
        bag.select("sample_id", "half", "rank", "pos", ar.array_sum("short_segment").alias("short_total"), ar.array_sum(ramp).alias("long_weighted"))
    )


@query(
    "event_bag",
    f"""WITH {src.SIGNALS}, {EVENTS}, fit AS (SELECT *, row_number() OVER (PARTITION BY sample_id, half ORDER BY rank) AS r2 FROM sel WHERE pos - 2 >= 0 AND pos + 2 <= 64)
    SELECT f.sample_id, f.half, CAST(r2 AS INT) AS rank, CAST(f.pos AS INT) AS pos, round(sum(x*(i-f.pos+3)),6) AS weighted FROM fit f JOIN fl ON fl.sample_id=f.sample_id AND fl.i >= f.pos-2 AND fl.i < f.pos+2
    WHERE r2 <= 3 GROUP BY ALL""",
)
def event_bag(spark, sf):
    bag = pu.event_bag(pu.detect_pulses(sig(spark, sf), POLICY), 4, 3)
    ramp = F.zip_with("segment", F.array(*[F.lit(float(k)) for k in range(1, 5)]), lambda x, w: x * w)
    return rounded(bag.select("sample_id", "half", "rank", "pos", ar.array_sum(ramp).alias("weighted")))


@query(
    "candidate_view",
    f"""WITH {src.SIGNALS}, {EVENTS} SELECT sample_id, half, CAST(rank AS INT) AS rank, CAST(pos AS INT) AS pos FROM sel WHERE rank <= 2""",
)
def candidate_view(spark, sf):
    bag = pu.pulse_bag(pu.detect_pulses(sig(spark, sf), POLICY), POLICY)
    return pu.candidate_view(bag, 2).select("sample_id", "half", "rank", "pos")


# Detectors ----------------------------------------------------------------------------

RAW = pu.DetectorSpec("raw", "none", 1, 0.0, 1024)
SHORT = (
    pu.DetectorSpec("current", "cycle", 1),
    pu.DetectorSpec("strict", "strict", 3, keep=6),
    pu.DetectorSpec("highpass", "highpass", 2, 0.5, 12, cutoff_hz=200.0, order=3),
    pu.DetectorSpec("polynomial", "polynomial", 2, 0.5, 12, window=9, degree=2),
)


@query("detect_events")
def detect_events(spark, sf):
    d = pu.detect_events(sig(spark, sf), SHORT, POLICY)
    return rounded(d.select("sample_id", "detector", "success", "alignment", "noise", "candidates", "boundary", F.size("peaks").alias("n")))


@query(
    "detect_current",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS}, nz AS (SELECT sample_id, greatest(1.4826 * median(abs(x - c)), 1e-6) AS noise FROM fl JOIN (SELECT sample_id, median(x) AS c FROM fl GROUP BY 1) USING (sample_id) GROUP BY 1),
      pz AS (SELECT sel.sample_id, (pos + origin) % 64 AS p FROM sel JOIN cur USING (sample_id)),
      ct AS (SELECT sample_id, count(*) AS n, count(*) FILTER (p < 2 OR p >= 62) AS edge FROM pz GROUP BY 1)
    SELECT cur.sample_id, 'current' AS detector, success, CASE WHEN NOT success THEN NULL WHEN inferred THEN 'INFERRED' ELSE 'VALID' END AS alignment, round(noise,6) AS noise,
      CAST(CASE WHEN success THEN coalesce(n, 0) END AS INT) AS candidates, CAST(CASE WHEN success THEN coalesce(edge, 0) END AS INT) AS boundary, CAST(coalesce(n, 0) AS INT) AS n
    FROM cur LEFT JOIN nz USING (sample_id) LEFT JOIN ct USING (sample_id)""",
)
def detect_current(spark, sf):
    """The registered cycle detector alone, outcome by outcome."""
    d = pu.detect_events(sig(spark, sf), [SHORT[0]], POLICY)
    return rounded(d.select("sample_id", "detector", "success", "alignment", "noise", "candidates", "boundary", F.size("peaks").alias("n")))


QUADS = ", ".join(
    [f"count(*) FILTER (i/64.0 >= {k / 4} AND i/64.0 < {(k + 1) / 4})::DOUBLE AS quadrant_{k:02d}_count" for k in range(4)]
    + [f"count(*) FILTER (i/64.0 >= {k / 20} AND i/64.0 < {(k + 1) / 20})::DOUBLE AS phase_bin_{k:02d}_count" for k in range(20)]
)


@query(
    "detector_features",
    f"""WITH {src.SIGNALS}, md AS (SELECT sample_id, median(v) AS c, stddev_pop(v) AS sd FROM samples GROUP BY 1),
      ct AS (SELECT s.sample_id, i, v - c AS x, abs(v-c) AS h, sd FROM samples s JOIN md USING (sample_id)),
      nz AS (SELECT sample_id, greatest(1.4826*median(h), 0.05*max(sd), 1e-6) AS noise FROM ct GROUP BY 1),
      pk AS (SELECT * FROM (SELECT ct.*, lag(h) OVER w AS a, lead(h) OVER w AS b FROM ct WINDOW w AS (PARTITION BY sample_id ORDER BY i)) WHERE h > a AND h > b),
      wd AS (SELECT p.sample_id, p.i, max(s.i)-min(s.i)+1 AS width FROM pk p JOIN samples s ON s.sample_id=p.sample_id AND abs(s.v) >= p.h*0.5 GROUP BY ALL),
      ev AS (SELECT pk.*, coalesce(width, 0) AS width, noise, pk.i - lag(pk.i) OVER (PARTITION BY pk.sample_id ORDER BY pk.i) AS gap FROM pk JOIN nz USING (sample_id) LEFT JOIN wd ON wd.sample_id=pk.sample_id AND wd.i=pk.i)
    SELECT sample_id, 'raw' AS detector, count(*)::DOUBLE AS candidate_count, count(*)::DOUBLE AS selected_count, round(max(noise),6) AS noise_mad, 0.0::DOUBLE AS boundary_fraction,
      round(median(h),6) AS score_median, round(quantile_cont(h,0.9),6) AS score_p90, round(max(h),6) AS score_max, round(quantile_cont(h/noise,0.9),6) AS snr_p90,
      round(avg(CAST(x>0 AS INT)),6) AS positive_fraction, round(coalesce(median(gap),0),6) AS spacing_median, round(coalesce(quantile_cont(gap,0.1),0),6) AS spacing_p10, round(median(width)::DOUBLE,6) AS width_median, {QUADS}
    FROM ev GROUP BY sample_id""",
)
def detector_features(spark, sf):
    d = pu.detect_events(sig(spark, sf), [RAW], POLICY)
    return rounded(pu.detector_features(d, 64))


@query("wide_detector_features")
def wide_detector_features(spark, sf):
    d = pu.detect_events(sig(spark, sf), SHORT, POLICY)
    return rounded(pu.wide_detector_features(pu.detector_features(d, 64), [s.name for s in SHORT]))


def positions(detector: str):
    return F.max(F.when(F.col("detector") == detector, F.transform("peaks", lambda p: p["pos"])))


@query("match_events")
def match_events(spark, sf):
    """Greedy one-to-one matching: checked by brute force in the tests."""
    d = pu.detect_events(sig(spark, sf), SHORT, POLICY).where("success")
    both = d.groupBy("sample_id").agg(positions("highpass").alias("a"), positions("polynomial").alias("b"))
    return rounded(both.where("a IS NOT NULL AND b IS NOT NULL").select("sample_id", pu.match_events("a", "b", 2).alias("m")).select("sample_id", "m.*"))


MATCH_SQL = f"""WITH RECURSIVE {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
  up AS (SELECT sample_id, list(i ORDER BY i) AS a FROM l WHERE v > a AND v > b GROUP BY 1), dn AS (SELECT sample_id, list(i ORDER BY i) AS b FROM l WHERE v < a AND v < b GROUP BY 1),
  st AS (SELECT sample_id, a AS todo, b AS free, CAST([] AS BIGINT[]) AS off, len(a) AS na, len(b) AS nb FROM up JOIN dn USING (sample_id)
    UNION ALL
    SELECT sample_id, todo[2:], CASE WHEN pick IS NULL THEN free ELSE list_filter(free, lambda x: x <> pick) END, CASE WHEN pick IS NULL THEN off ELSE list_append(off, pick - todo[1]) END, na, nb
    FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda x: abs(x - todo[1]) <= 3), lambda x: [abs(x - todo[1]), x]))[1][2] AS pick FROM st WHERE len(todo) > 0))
  SELECT sample_id, CAST(na AS INT) AS left_count, CAST(nb AS INT) AS right_count, CAST(len(off) AS INT) AS matched, round(len(off)::DOUBLE / greatest(na + nb - len(off), 1),6) AS matched_fraction,
    round(coalesce(list_median(off), 'nan'::DOUBLE),6) AS median_offset, round(coalesce(list_median(list_transform(off, lambda x: abs(x))), 'nan'::DOUBLE),6) AS median_abs_offset FROM st WHERE len(todo) = 0"""


@query("match_peaks", MATCH_SQL)
def match_peaks(spark, sf):
    """Maxima matched to minima at most three samples away, one to one, in order of position."""
    s = sig(spark, sf)
    found = s.select("sample_id", pu.find_peaks("values").alias("a"), pu.find_peaks(F.transform("values", lambda x: -x)).alias("b"))
    both = found.where((F.size("a") > 0) & (F.size("b") > 0)).select("sample_id", *[F.transform(c, lambda p: p["pos"]).alias(c) for c in ("a", "b")])
    return rounded(both.select("sample_id", pu.match_events("a", "b", 3).alias("m")).select("sample_id", "m.*"))


@query(
    "match_candidates",
    f"""WITH {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
      up AS (SELECT sample_id, i FROM l WHERE v > a AND v > b), dn AS (SELECT sample_id, i FROM l WHERE v < a AND v < b)
    SELECT up.sample_id, CAST(up.i AS INT) AS left_pos, CAST(dn.i AS INT) AS right_pos FROM up JOIN dn ON up.sample_id=dn.sample_id AND abs(up.i-dn.i) <= 3""",
)
def match_candidates(spark, sf):
    s = sig(spark, sf)
    up = s.select("sample_id", F.explode(pu.find_peaks("values")).alias("p")).select("sample_id", "p.pos")
    down = s.select("sample_id", F.explode(pu.find_peaks(F.transform("values", lambda x: -x))).alias("p")).select("sample_id", "p.pos")
    return pu.match_candidates(up, down, 3)


@query(
    "polarity",
    f"""WITH {src.SIGNALS} SELECT sample_id, CAST(sign(arg_max(v, abs(v))) AS INT) AS polarity FROM samples GROUP BY 1""",
)
def polarity(spark, sf):
    return sig(spark, sf).select("sample_id", pu.polarity("values").alias("polarity"))


@query(
    "phase_effects",
    f"""WITH {src.SIGNALS}, l AS (SELECT sample_id, target, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
      c AS (SELECT g.sample_id, g.target, k, count(l.i) AS n FROM signals g CROSS JOIN range(4) r(k) LEFT JOIN l ON l.sample_id=g.sample_id AND l.i // 16 = k AND v > a AND v > b GROUP BY ALL)
    SELECT 'bin_' || k AS phase_bin, target, count(*) AS n, round(avg(n),6) AS mean, round(median(n),6) AS median, round(quantile_cont(n,0.9),6) AS p90 FROM c GROUP BY k, target""",
)
def phase_effects(spark, sf):
    from sigloom.operators.metrics import phase_effects as effects

    peaks = src.signals(spark, sf).withColumn("p", pu.find_peaks("values"))

    def inside(k):
        return F.size(F.filter("p", lambda e: F.floor(e["pos"] / 16) == k)).cast("double")

    bins = [inside(k).alias(f"bin_{k}") for k in range(4)]
    return rounded(effects(peaks.select("sample_id", "target", *bins), [f"bin_{k}" for k in range(4)]))


# Spectra ------------------------------------------------------------------------------

STFT = sx.StftSpec(16, 12, 8, rate_hz=3200.0, f_min_hz=500.0)
STFT_SQL = """st AS (SELECT sample_id, f, k, ln(power(sum(v*(0.5-0.5*cos(2*pi()*(i-f*8)/12))*cos(2*pi()*k*(i-f*8)/16)),2)
   + power(sum(v*(0.5-0.5*cos(2*pi()*(i-f*8)/12))*sin(2*pi()*k*(i-f*8)/16)),2) + 1e-8) AS p
  FROM samples JOIN range(7) a(f) ON i >= f*8 AND i < f*8+12, range(9) b(k) GROUP BY ALL)"""


@query("spectrogram", f"WITH {src.SIGNALS}, {STFT_SQL} SELECT sample_id, CAST(f AS INT) AS frame, CAST(k AS INT) AS bin, round(p,6) AS power FROM st")
def spectrogram(spark, sf):
    s = sx.spectrogram(sig(spark, sf), STFT)
    return rounded(s.select("sample_id", "frame", F.posexplode("power").alias("bin", "power")))


@query(
    "full_signal_spectrogram",
    f"WITH {src.SIGNALS}, {STFT_SQL} SELECT sample_id, CAST(f AS INT) AS frame, CAST(k-3 AS INT) AS bin, round(p*10/ln(10),6) AS power FROM st WHERE k >= 3",
)
def full_signal_spectrogram(spark, sf):
    s = sx.spectrogram(sig(spark, sf), STFT, decibel=True, crop=True)
    return rounded(s.select("sample_id", "frame", F.posexplode("power").alias("bin", "power")))


@query(
    "fit_frequency_standardizer",
    f"WITH {src.SIGNALS}, {STFT_SQL} SELECT CAST(k AS INT) AS bin, count(*) AS n, round(avg(p),6) AS mean, round(stddev_pop(p),6) AS std FROM st GROUP BY k",
)
def fit_frequency_standardizer(spark, sf):
    return rounded(sx.fit_frequency_standardizer(sx.spectrogram(sig(spark, sf), STFT)))


@query(
    "fit_spectrogram_standardizer",
    f"WITH {src.SIGNALS}, {STFT_SQL} SELECT CAST(k AS INT) AS bin, CAST(f AS INT) AS frame, count(*) AS n, round(avg(p),6) AS mean, round(stddev_pop(p),6) AS std FROM st GROUP BY ALL",
)
def fit_spectrogram_standardizer(spark, sf):
    return rounded(sx.fit_spectrogram_standardizer(sx.spectrogram(sig(spark, sf), STFT)))


@query(
    "fft_magnitude",
    f"WITH {src.SIGNALS}, {DFT} SELECT sample_id, CAST(k AS INT) AS bin, round(ln(1+sqrt(re*re+im*im)),6) AS magnitude FROM dft",
)
def fft_magnitude(spark, sf):
    return rounded(sig(spark, sf).select("sample_id", F.posexplode(sx.fft_magnitude("values")).alias("bin", "magnitude")))


SCALES = (1.5, 3.0, 6.0, 12.0)
# Circular correlation with the wavelet in the time domain; sample indices round(63*b/7).
CWT_SQL = """sc AS (SELECT * FROM (VALUES (0,1.5),(1,3.0),(2,6.0),(3,12.0)) t(s, a)), bi AS (SELECT b, CAST(round_even(63.0*b/7, 0) AS BIGINT) AS t FROM range(8) r(b)),
  kr AS (SELECT s, m, exp(-0.5*power(((m+32)%64 - 32)/a,2))/sqrt(a)*cos(6*((m+32)%64 - 32)/a) AS kr, exp(-0.5*power(((m+32)%64 - 32)/a,2))/sqrt(a)*sin(6*((m+32)%64 - 32)/a) AS ki FROM sc, range(64) r(m)),
  cw AS (SELECT sample_id, s, b, power(sum(v*kr),2) + power(sum(v*ki),2) AS p FROM samples, bi JOIN kr ON true WHERE m = (i - t + 64) % 64 GROUP BY ALL)"""


def cwt_sql(source: str, ids: str, n: int, bins: int) -> str:
    """The same transform over a table of (ids, i, v) rows of length n."""
    h = n // 2
    return f"""sc AS (SELECT * FROM (VALUES (0,1.5),(1,3.0),(2,6.0),(3,12.0)) t(s, a)), bi AS (SELECT b, CAST(round_even({n - 1}.0*b/{bins - 1}, 0) AS BIGINT) AS t FROM range({bins}) r(b)),
     kr AS (SELECT s, m, exp(-0.5*power(((m+{h})%{n} - {h})/a,2))/sqrt(a)*cos(6*((m+{h})%{n} - {h})/a) AS kr, exp(-0.5*power(((m+{h})%{n} - {h})/a,2))/sqrt(a)*sin(6*((m+{h})%{n} - {h})/a) AS ki FROM sc, range({n}) r(m)),
     cw AS (SELECT {ids}, s, b, power(sum(v*kr),2) + power(sum(v*ki),2) AS p FROM {source}, bi JOIN kr ON true WHERE m = (i - t + {n}) % {n} GROUP BY ALL)"""


@query(
    "cwt_rows",
    f"WITH {src.SIGNALS}, {CWT_SQL} SELECT sample_id, CAST(s AS INT) AS scale, CAST(b AS INT) AS bin, round(greatest(ln(p+1e-8),-10),6) AS power FROM cw",
)
def cwt_rows(spark, sf):
    return rounded(sx.cwt_rows(sig(spark, sf), SCALES, 8))


@query(
    "cwt_embedding",
    f"WITH {src.SIGNALS}, {CWT_SQL} SELECT sample_id, CAST(s//2 AS INT) AS scale_group, CAST(b//4 AS INT) AS time_group, round(avg(greatest(ln(p+1e-8),-10)),6) AS power FROM cw GROUP BY sample_id, s//2, b//4",
)
def cwt_embedding(spark, sf):
    return rounded(sg.cwt_embedding(sx.cwt_rows(sig(spark, sf), SCALES, 8), 4, 8, groups=2))


@query(
    "cwt_summary",
    f"""WITH {src.SIGNALS}, {CWT_SQL}, q AS (SELECT sample_id, s, b, p+1e-8 AS p FROM cw), tt AS (SELECT sample_id, sum(p) AS t FROM q GROUP BY 1),
      en AS (SELECT sample_id, s, sum(p) AS e FROM q GROUP BY ALL), ee AS (SELECT sample_id, max(e) FILTER (s=0) AS lo, max(e) FILTER (s=1) AS mi, avg(e) FILTER (s>=2) AS hi, arg_max(s, e)::DOUBLE AS top FROM en GROUP BY 1),
      te AS (SELECT sample_id, max(x) AS m FROM (SELECT sample_id, b, sum(p) AS x FROM q GROUP BY ALL) GROUP BY 1)
    SELECT sample_id, round(max(lo),6) AS cwt_energy_low, round(max(mi),6) AS cwt_energy_mid, round(max(hi),6) AS cwt_energy_high, round(avg(ln(p)),6) AS cwt_log_power_mean, round(stddev_pop(ln(p)),6) AS cwt_log_power_std,
      round(-sum(p/t*ln(p/t+1e-12)),6) AS cwt_entropy, round(max(m)/max(t),6) AS cwt_temporal_concentration, max(top) AS cwt_scale_of_max
    FROM q JOIN tt USING (sample_id) JOIN ee USING (sample_id) JOIN te USING (sample_id) GROUP BY 1""",
)
def cwt_summary(spark, sf):
    return rounded(sig(spark, sf).select("sample_id", sx.cwt_summary("values", SCALES, 8).alias("c")).select("sample_id", "c.*"))


@query(
    "cwt_features",
    f"""WITH {src.SIGNALS}, {TIED_EVENTS}, {BAG}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amplitude DESC, pos) AS r6 FROM bag) WHERE r6 <= 6),
      sgm AS (SELECT t.sample_id, t.r6, o + 4 AS i, v FROM tp t, range(-4, 4) r(o) JOIN ro ON true WHERE ro.sample_id = t.sample_id AND ro.i = (t.pos + o + 64) % 64),
      {cwt_sql('sgm', 'sample_id, r6', 8, 4)}, q AS (SELECT sample_id, r6, s, b, p+1e-8 AS p FROM cw), tt AS (SELECT sample_id, r6, sum(p) AS t FROM q GROUP BY ALL),
      en AS (SELECT sample_id, r6, s, sum(p) AS e FROM q GROUP BY ALL), ee AS (SELECT sample_id, r6, max(e) FILTER (s=0) AS lo, max(e) FILTER (s=1) AS mi, avg(e) FILTER (s>=2) AS hi, arg_max(s, e)::DOUBLE AS top FROM en GROUP BY ALL),
      te AS (SELECT sample_id, r6, max(x) AS m FROM (SELECT sample_id, r6, b, sum(p) AS x FROM q GROUP BY ALL) GROUP BY ALL),
      su AS (SELECT sample_id, r6, max(lo) AS lo, max(mi) AS mi, max(hi) AS hi, avg(ln(p)) AS lm, stddev_pop(ln(p)) AS ls, -sum(p/t*ln(p/t+1e-12)) AS en, max(m)/max(t) AS tc, max(top) AS top
        FROM q JOIN tt USING (sample_id, r6) JOIN ee USING (sample_id, r6) JOIN te USING (sample_id, r6) GROUP BY ALL)
    SELECT sample_id, count(*)::DOUBLE AS cwt_event_count, round(avg(lo),6) AS cwt_energy_low, round(avg(mi),6) AS cwt_energy_mid, round(avg(hi),6) AS cwt_energy_high, round(avg(lm),6) AS cwt_log_power_mean,
      round(avg(ls),6) AS cwt_log_power_std, round(avg(en),6) AS cwt_entropy, round(avg(tc),6) AS cwt_temporal_concentration, round(avg(top),6) AS cwt_scale_of_max FROM su GROUP BY 1""",
)
def cwt_features(spark, sf):
    bag = pu.pulse_bag(pu.detect_pulses(sig(spark, sf), POLICY), POLICY)
    return rounded(sx.cwt_features(bag, SCALES, 4, segment="long_segment"))


@query(
    "window_bags",
    f"""WITH {src.SIGNALS}, st AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s FROM (SELECT DISTINCT least(k*10, 48) AS s FROM range(6) r(k))),
      wi AS (SELECT sample_id, split, w, samples.i - st.s AS i, v FROM samples JOIN st ON samples.i >= st.s AND samples.i < st.s + 16), {cwt_sql('wi', 'sample_id, split, w', 16, 4)},
      lp AS (SELECT *, greatest(ln(p+1e-8), -10) AS l FROM cw), mm AS (SELECT s, b, avg(l) AS mean, stddev_pop(l) AS std FROM lp WHERE split='train' GROUP BY ALL)
    SELECT sample_id, CAST(w AS INT) AS window_index, round(avg((l-mean)/std),6) AS mean, CAST(count(*) AS INT) AS n FROM lp JOIN mm USING (s, b) GROUP BY sample_id, w""",
)
def window_bags(spark, sf):
    """Standardized log-power bags per window; moments from training windows only."""
    s = src.signals(spark, sf).select("sample_id", "split", "values")
    bags = sx.window_bags(s, SPEC, "cwt", SCALES, 4)
    z = sg.standardize(bags, sg.fit_standardizer(bags.where("split = 'train'")))
    return rounded(z.select("sample_id", "window_index", ar.array_mean("values").alias("mean"), F.size("values").alias("n")))


@query(
    "event_spectrograms",
    f"""WITH {src.SIGNALS}, {EVENTS}, fit AS (SELECT *, row_number() OVER (PARTITION BY sample_id, half ORDER BY rank) AS r2 FROM sel WHERE pos - 4 >= 0 AND pos + 4 <= 64),
      bg AS (SELECT f.sample_id, half, r2, i - f.pos + 4 AS n, x FROM fit f JOIN fl ON fl.sample_id=f.sample_id AND fl.i >= f.pos-4 AND fl.i < f.pos+4 WHERE r2 <= 2)
    SELECT sample_id, half, CAST(r2 AS INT) AS rank, CAST(f AS INT) AS frame, CAST(k AS INT) AS bin,
      round(ln(power(sum(x*(0.5-0.5*cos(2*pi()*(n-f*2)/4))*cos(2*pi()*k*(n-f*2)/4)),2) + power(sum(x*(0.5-0.5*cos(2*pi()*(n-f*2)/4))*sin(2*pi()*k*(n-f*2)/4)),2) + 1e-8),6) AS power
    FROM bg JOIN range(3) a(f) ON n >= f*2 AND n < f*2+4, range(3) b(k) GROUP BY ALL""",
)
def event_spectrograms(spark, sf):
    bag = pu.event_bag(pu.detect_pulses(sig(spark, sf), POLICY), 8, 2)
    e = sx.event_spectrograms(bag, sx.StftSpec(4, 4, 2))
    return rounded(e.select("sample_id", "half", "rank", "frame", F.posexplode("power").alias("bin", "power")))
