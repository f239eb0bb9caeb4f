"""Small vectors with known results."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sigloom.functions import arrays as ar
from sigloom.functions import fusion as fz
from sigloom.operators import audits, checks, gates, joins, meta, metrics, splits, sweeps
from sigloom.operators import models as mo
from sigloom.operators import projections as pr
from sigloom.operators import pulses as pu
from sigloom.operators import resampling as rs
from sigloom.operators import signals as sg
from sigloom.operators import spectra as sx
from sigloom.sources import tables as tb
from sigloom.streaming import arrivals as st


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_window_starts(spark):
    assert sg.WindowSpec(4, 4).starts(10) == [0, 4, 6]
    df = spark.createDataFrame([("a", [float(v) for v in range(10)])], "sample_id string, values array<double>")
    got = rows(sg.windows(df, sg.WindowSpec(4, 4)).select("start", "values"), "start")
    assert got[-1] == (6, [6.0, 7.0, 8.0, 9.0]) and [g[0] for g in got] == [0, 4, 6]
    with pytest.raises(ValueError):
        sg.WindowSpec(4, 5)
    with pytest.raises(PySparkException):
        sg.windows(df, sg.WindowSpec(11, 4)).collect()


def test_window_map_rejects_split_group(spark):
    good = spark.createDataFrame([("a", "g", "train"), ("b", "h", "test")], "sample_id string, id_measurement string, split string")
    got = rows(sg.window_map(good, 3).select("parent_id", "window_index"), "parent_id", "window_index")
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    bad = spark.createDataFrame([("a", "g", "train"), ("b", "g", "test")], "sample_id string, id_measurement string, split string")
    with pytest.raises(checks.ContractError):
        sg.window_map(bad, 3)


def test_top_k(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.9],), ([0.3, 0.4, 0.5],)], "p array<double>")
    got = [round(r[0], 6) for r in df.select(ar.top_k_mean("p", 0.5)).collect()]
    assert got == [0.55, 0.45]


def test_fusion_rules(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.50, 0.52), (0.6, 0.8, 0.9, 0.1)], "f double, a double, rt double, rs double")
    got = [r[0] for r in df.select(fz.conservative("f", "a", "rt", "rs", F.lit(0.05))).collect()]
    assert got == [0.4, 0.8]
    wt, ws = fz.adaptive_weights(F.lit(0.9), F.lit(0.1))
    w = spark.range(1).select(wt, ws).first()
    assert abs(sum(w) - 1) < 1e-6 and w[0] != w[1]


def test_perfect_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "target int, probability double").withColumn("threshold", F.lit(0.5))
    assert metrics.binary_metrics(df, []).first()["mcc"] == 1.0
    r = metrics.ranking_metrics(df, []).first()
    assert r["roc_auc"] == 1.0 and r["average_precision"] == 1.0
    one = metrics.ranking_metrics(df.where("target = 1"), []).first()
    assert math.isnan(one["roc_auc"])


def test_metrics_survive_large_counts(spark):
    n = 3_000_000_000
    row = spark.createDataFrame([(n, n // 3, n // 4, n)], "tn bigint, fp bigint, fn bigint, tp bigint")
    from sigloom.functions.confusion import mcc

    assert abs(row.select(mcc()).first()[0] - 8.25 / 15.0) < 1e-9


def test_phase_patterns(spark):
    df = spark.createDataFrame(
        [("m1", "0", 0), ("m1", "1", 0), ("m1", "2", 1), ("m2", "0", 1), ("m2", "1", 1), ("m2", "2", 1)],
        "id_measurement string, phase string, target int",
    )
    got = {r["pattern"]: r["measurements"] for r in audits.phase_patterns(df).collect()}
    assert got.pop("001") == 1 and got.pop("111") == 1 and set(got.values()) == {0} and len(got) == 6


def test_moments_leave_third_signal_at_998(spark):
    data = [(k, f, [float(v)] * 2) for k, v in enumerate((1, 3, 1000)) for f in range(4)]
    s = spark.createDataFrame(data, "sample_id int, frame int, power array<double>")
    m = sx.fit_frequency_standardizer(s.where("sample_id < 2"))
    assert {tuple(r)[1:] for r in m.collect()} == {(8, 2.0, 1.0)}
    z = sg.standardize(s.where("sample_id = 2").withColumnRenamed("power", "values"), m.withColumnRenamed("bin", "pos"))
    assert z.select(F.explode("values")).distinct().collect()[0][0] == 998.0


def test_masked_events_are_absent_rows(spark):
    data = [(s, h, e, [float(e)]) for s in range(2) for h in range(2) for e in range(3) if (s, h, e) != (1, 1, 2)]
    df = spark.createDataFrame(data, "sample_id int, half int, frame int, power array<double>")
    assert df.count() == 11
    m = sx.fit_spectrogram_standardizer(df.withColumn("frame", F.lit(0)))
    assert m.first()["n"] == 11


def test_stft_shapes(spark):
    import numpy as np

    df = spark.createDataFrame([("a", np.ones(400).tolist())], "sample_id string, values array<double>")
    spec = sx.StftSpec(128, 64, 16)
    got = sx.spectrogram(df, spec).agg(F.count(F.lit(1)), F.max(F.size("power"))).first()
    assert tuple(got) == (22, 65) and spec.frames(512) == 29
    assert sx.StftSpec(128, 128, 32).frames(512) == 13
    full = sx.StftSpec(512, 512, 256, rate_hz=40e6, f_min_hz=0.5e6)
    assert (full.first_bin, full.kept_bins, full.frames(8000)) == (7, 250, 30)
    with pytest.raises(ValueError):
        sx.StftSpec(64, 128, 16)


def test_inferred_crossing(spark):
    step = [-1.0] * 4000 + [1.0] * 4000
    policy = pu.PulsePolicy(length=8000, smoothing=101)
    df = spark.createDataFrame([(step,)], "values array<double>")
    c = df.select(pu.cycle_reference("values", policy).alias("c")).select("c.*").first()
    assert c["success"] and c["inferred"] and (c["origin"], c["opposite"]) == (4000, 0)
    strict = df.select(pu.cycle_reference("values", policy, strict=True).alias("c")).select("c.*").first()
    assert not strict["success"] and strict["reason"]


def test_pulses_of_a_sine(spark):
    import numpy as np

    x = np.sin(2 * np.pi * np.arange(8000) / 8000)
    x[[1200, 1600, 2200, 4600, 5200, 6200]] += 4.0
    policy = pu.PulsePolicy(length=8000, smoothing=101, min_distance=64, min_pulses=3, pulses_per_half=8, short_segment=16, long_segment=64)
    df = spark.createDataFrame([("a", x.tolist())], "sample_id string, values array<double>")
    d = pu.detect_pulses(df, policy)
    events = pu.pulse_events(d)
    found = {r["pos"] for r in events.where("rank <= 3").collect()}
    origin = d.select("cycle.origin").first()[0]
    assert {(p - origin) % 8000 for p in (1200, 1600, 2200, 4600, 5200, 6200)} == found
    # The fused detector and the event-table operators keep the same number of pulses.
    every = d.select("sample_id", F.explode(pu.find_peaks(F.transform("flattened", F.abs), 64)).alias("p")).select(
        "sample_id", (F.col("p.pos") >= 4000).cast("int").alias("half"), F.col("p.pos").alias("pos"), F.col("p.score").alias("amplitude")
    )
    kept = {r["half"]: r["selected"] for r in pu.knee_counts(every, 9, 3).collect()}
    assert kept == {r["half"]: r["count"] for r in events.groupBy("half").count().collect()}
    bag = pu.pulse_bag(d, policy)
    assert bag.agg(F.min(F.size("short_segment")), F.max(F.size("long_segment"))).first() == (16, 64)
    report = pu.coverage(events, df, 8).first()
    assert report["signals_with_both_halves"] == 1 and report["coverage_ok"]


def test_event_bag_drops_boundary_then_ranks(spark):
    half, n, length = 4000, 8000, 512
    pulses = [(0, 1, 1), (0, 2, 1000), (1, 1, half + 1000), (1, 2, n - 1)]
    data = [("a", [float(v) for v in range(n)], [(h, r, p, 1.0, 1) for h, r, p in pulses])]
    df = spark.createDataFrame(data, f"sample_id string, flattened array<double>, pulses {pu.PULSES}")
    bag = pu.event_bag(df, length, 2)
    got = rows(bag.select("half", "rank", "pos", F.element_at("segment", 1), F.element_at("segment", -1)), "half")
    assert got == [(0, 1, 1000, 744.0, 1255.0), (1, 1, half + 1000, half + 744.0, half + 1255.0)]
    empty = df.withColumn("pulses", F.filter("pulses", lambda p: p["half"] == 0))
    with pytest.raises(PySparkException):
        pu.event_bag(empty, length, 2).collect()


def three_phase(spark, missing=False):
    data = [(f"m{m}-{p}", f"m{m}", str(p), int(p == 1), "train", 0, float(p)) for m in (1, 2) for p in range(3)]
    return spark.createDataFrame(
        data[:-1] if missing else data,
        "sample_id string, id_measurement string, phase string, target int, split string, oof_fold int, x double",
    )


def test_three_phase_features(spark):
    got = audits.three_phase_features(three_phase(spark), ["x"]).where("sample_id = 'm1-1'").first()
    assert (got["target"], got["phase_0_x"], got["phase_2_x"]) == (1, 0.0, 2.0)
    with pytest.raises(PySparkException):
        audits.three_phase_features(three_phase(spark, True), ["x"]).collect()


def test_overlap(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 1)], "y int, a int, b int")
    got = {(r["stratum"], r["state"]): r["count"] for r in metrics.overlap_states(df, [], "y", "a", "b").collect()}
    want = {("all", "both_correct"): 1, ("all", "a_only"): 1, ("all", "b_only"): 2, ("all", "both_wrong"): 0}
    assert {k: v for k, v in got.items() if k[0] == "all"} == want
    o = metrics.overlap_oracle(df, [], "y", "a", "b").first()
    assert o["oracle_mcc"] >= o["stronger_mcc"]


def pair(spark, n=120):
    data = [(i, f"g{i // 3}", i % 2, int((i * 7) % 10 < 7) if i % 2 else int((i * 3) % 10 < 3), int((i * 3) % 10 < 6) if i % 2 else int((i * 9) % 10 < 4)) for i in range(n)]
    return spark.createDataFrame(data, "sample_id int, g string, y int, a int, b int")


def test_bootstrap_is_repeatable_and_covers_point(spark):
    p = pair(spark)
    once = rs.bootstrap_delta(p, [], "y", "a", "b", 400, group="g").first()
    again = rs.bootstrap_delta(p.repartition(3), [], "y", "a", "b", 400, group="g").first()
    assert once == again
    assert once["ci_low"] <= once["point_estimate"] <= once["ci_high"] and once["iterations"] == 400
    single = rs.bootstrap_delta(p, [], "y", "a", "b", 400).first()
    assert single["ci_low"] <= single["point_estimate"] <= single["ci_high"]


def test_group_bootstrap_buckets_agree_with_one_bucket(spark):
    p = pair(spark, 600)
    whole, split = (
        rs.summarize(rs.group_replicates(p, [], "g", "y", "a", "b", 1500, buckets=buckets)).first() for buckets in (1, 40)
    )
    assert abs(whole["bootstrap_mean"] - split["bootstrap_mean"]) < 0.01
    assert abs((whole["ci_high"] - whole["ci_low"]) - (split["ci_high"] - split["ci_low"])) < 0.03


def test_feature_families():
    cols = pr.canonical_features()
    inventory = pr.feature_inventory(cols)
    counts = {f: sum(1 for _, _, g in inventory if g == f) for f in "STC"}
    assert len(cols) == 153 and counts == {"S": 113, "T": 32, "C": 8}
    assert [len(pr.feature_set(inventory, s)) for s in pr.FEATURE_SETS] == [113, 145, 121, 153]
    with pytest.raises(checks.ContractError):
        pr.feature_inventory(["target"])


def predictions(spark, extra=()):
    data = [
        (f"s{i}", f"g{i // 3}", str(i % 3), i % 2, "wide", split, seed, method, (i % 10) / 10.0, 0.5, 0)
        for seed in (42, 43, 44) for split in ("train_oof", "validation") for i in range(30) for method in ("temporal", "spectral")
    ]
    schema = "sample_id string, id_measurement string, phase string, target int, dataset string, split string, seed int, method string, probability double, threshold double, prediction int"
    return spark.createDataFrame(data + list(extra), schema)


@pytest.mark.parametrize(
    "row,flag",
    [
        (("x", "g", "0", 0, "wide", "test", 42, "temporal", 0.5, 0.5, 0), "holdout_rows"),
        (("s0", "g0", "0", 0, "wide", "validation", 42, "temporal", 0.5, 0.5, 0), "duplicates"),
        (("x", "g", "0", 0, "wide", "validation", 42, "temporal", float("nan"), 0.5, 0), "non_finite"),
    ],
)
def test_source_contract(spark, row, flag):
    good = gates.source_contract(predictions(spark), ["temporal", "spectral"], [42, 43, 44]).first()
    assert good["status"] == "PASS" and good["rows"] == 360
    bad = gates.source_contract(predictions(spark, [row]), ["temporal", "spectral"], [42, 43, 44]).first()
    assert bad["status"] == "FAIL" and bad[flag] > 0
    assert len(fz.reliability_features("a", "b")) == 11


def test_pairing_rejects_missing_expert(spark):
    p = predictions(spark)
    assert joins.pair_experts(p, "temporal", "spectral").count() == 180
    with pytest.raises(PySparkException):
        joins.pair_experts(p.where("NOT (sample_id = 's1' AND method = 'spectral')"), "temporal", "spectral").collect()


def test_unique_join_rejects_duplicates(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException):
        joins.join_many_to_one(left, right, ["k"]).collect()
    with pytest.raises(PySparkException):
        joins.lookup(right, left, ["k"]).collect()
    with pytest.raises(checks.ContractError):
        joins.assert_same_keys(left, right, ["k"])
    with pytest.raises(checks.ContractError):
        pr.assert_no_holdout(spark.createDataFrame([("test",)], "split string"))


def test_gates(spark):
    def single(*best):
        df = spark.createDataFrame([("c", s, b, b, 1.0) for s, b in enumerate(best)], "candidate string, seed int, best_individual_mcc double, minimum_expert_mcc double, compute_cost double")
        return gates.single_score_gate(df).first()["status"]

    assert (single(0.60), single(0.65), single(0.72, 0.75)) == ("STOP", "WEAK_DO_NOT_FREEZE", "PASS")

    def double(rows_, cost=1.0, name="c"):
        return gates.two_score_gate(
            spark.createDataFrame([(name, a, b, cost) for a, b in rows_], "candidate string, temporal_validation_mcc double, cwt_validation_mcc double, compute_cost double")
        )

    assert double([(0.5, 0.9)] * 3).first()["status"] == "STOP"
    assert double([(0.68, 0.62)] * 3).first()["status"] == "REVIEW_DO_NOT_FREEZE"
    passing = double([(0.75, 0.70)] * 3, 2.0, "dear").unionByName(double([(0.75, 0.70)] * 3, 1.0, "cheap"))
    assert gates.select_candidate(passing, "mean_second").first()["candidate"] == "cheap"
    deltas = spark.createDataFrame([("adaptive_minus_best_fixed", s, d, 0.001) for s, d in enumerate((0.01, 0.02, 0.01))], "comparison string, seed int, delta double, ci_low double")
    assert gates.fusion_gate(deltas).first()["passed"]
    m = spark.createDataFrame([(s, "spectral", v) for s, v in zip((42, 43, 44), (0.56, 0.60, 0.55))], "seed int, method string, mcc double")
    assert gates.expert_gate(m, [], ["spectral"], 0.55, 0.50).first()["eligible"]
    assert not gates.expert_gate(m.where("seed < 44"), [], ["spectral"], 0.55, 0.50).first()["eligible"]


def test_representation_contract(spark):
    root = st.work_path(spark, "test")
    df = spark.range(10)
    params = {"window": 4, "kind": "x"}
    path = tb.save_representation(df, root, params)
    assert tb.save_representation(df, root, {"kind": "x", "window": 4}) == path
    assert tb.load_representation(spark, root, params).count() == 10
    with pytest.raises(checks.ContractError):
        tb.load_representation(spark, root, {"window": 5, "kind": "x"})
    # Data without a manifest is an interrupted write.
    other = {"window": 6}
    spark.range(3).write.parquet(f"{root}/{tb.parameter_fingerprint(other)}/data")
    with pytest.raises(checks.ContractError):
        tb.load_representation(spark, root, other)


def test_manifest_invariants(spark):
    data = [(f"s{g}-{p}", f"g{g}", str(p), int(g % 4 == 0 and p == 0)) for g in range(30) for p in range(3)]
    df = spark.createDataFrame(data, "sample_id string, id_measurement string, phase string, target int")
    m = splits.grouped_manifest(df)
    assert m.count() == 90 and joins.group_overlap(m).isEmpty()
    assert {r[0] for r in m.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert {r[0] for r in m.where("split = 'train'").select("oof_fold").distinct().collect()} == set(range(5))
    report = splits.validate_manifest(m).first()
    assert report["oof_folds"] == 5 and not any(report[c] for c in report.asDict() if c.endswith("_errors"))
    nested = splits.nested_folds(df, 5, 4, 42, group="id_measurement")
    assert nested.groupBy("outer_fold", "id_measurement").count().where("count > 1").isEmpty()


def test_logistic_is_at_its_optimum(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=400) > 0.5).astype(int)
    df = spark.createDataFrame([(int(i % 2), float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "k int, a double, b double, y int")
    m = mo.fit_logistic(df, ["k"], ["a", "b"], "y")
    for key in (0, 1):
        w = np.array({r["k"]: r["_coef"] for r in m.table.collect()}[key])
        xi, yi = np.c_[np.ones(200), x[key::2]], y[key::2]
        grad = xi.T @ (1 / (1 + np.exp(-xi @ w)) - yi) + np.r_[0, w[1:]]
        assert np.abs(grad).max() < 1e-5
    constant = mo.fit_logistic(df.where("y = 1"), [], ["a"], "y")
    assert constant.score(df, "p").agg(F.min("p")).first()[0] > 0.999


def test_cross_fit_scores_every_row_once(spark):
    data = [(i, f"g{i // 2}", i % 2, float((i * 37) % 11) + 3.0 * (i % 2)) for i in range(80)]
    df = splits.grouped_folds(spark.createDataFrame(data, "sample_id int, id_measurement string, target int, x double"), 4, 1)
    out = mo.cross_fit(df, ["x"])
    assert out.count() == 80 and out.select("sample_id").distinct().count() == 80
    assert metrics.roc_auc(out, []).first()["roc_auc"] > 0.6


def test_threshold_grid_cells_match_comparison(spark):
    import random

    random.seed(5)
    values = [k / 200.0 for k in range(201)] + [k / 400.0 for k in range(401)] + [random.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for v, k in df.select("p", sweeps.grid_cell("p")).collect():
        want = max([j for j in range(10, 191) if v >= j / 200.0], default=9)
        assert k == want, v


def test_ordered_prefix_handles_one_hot_value(spark):
    from sigloom.operators.ordering import exact_quantiles, global_rank

    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 100.0).alias("v"))
    ranks = global_rank(df, [], ["v", "id"])
    pdf = ranks.toPandas().sort_values(["v", "id"])
    assert pdf["rank"].tolist() == list(range(1, 1001))
    q = exact_quantiles(df, [], "v", {"a": 0.13, "b": 0.5}).first()
    import numpy as np

    values = df.toPandas()["v"].to_numpy()
    assert np.allclose([q["a"], q["b"]], np.quantile(values, [0.13, 0.5]))


def test_override_gate(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.9), (0, 0, 1, 0.6), (1, 1, 1, 0.1), (0, 0, 0, 0.1)], "y int, a int, b int, s double")
    best = sweeps.select_tau(df, [], "y", "a", "b", "s").first()
    assert best["mcc"] == 1.0 and best["k"] == 121 and best["beneficial"] == 1


def test_perceptron_cross_fit(spark):
    data = [(i, f"g{i // 2}", i % 2, float(i % 2) + (i % 7) / 10.0, float(i % 5)) for i in range(120)]
    df = splits.grouped_folds(spark.createDataFrame(data, "sample_id int, id_measurement string, target int, x double, z double"), 2, 1)
    out = mo.cross_fit(df, ["x", "z"], "mlp", iterations=15)
    assert out.count() == 120 and out.where("probability < 0 OR probability > 1").isEmpty()


def test_fold_transform_sees_fit_rows_only(spark):
    data = [(i, i % 2, i % 2, float("nan") if i % 10 == 0 else float(i % 2) * 100 + i) for i in range(40)]
    df = spark.createDataFrame(data, "sample_id int, fold int, target int, x double").withColumn("fold", (F.col("sample_id") / 20).cast("int"))
    seen = []

    def transform(fit, rows):
        seen.append({r[0] for r in fit.select("fold").distinct().collect()})
        return mo.impute_transform(["x"])(fit, rows)

    assert mo.cross_fit(df, ["x"], fold_transform=transform).count() == 40
    assert seen == [{1}, {1}, {0}, {0}]


def test_meta_fusion_covers_every_row_and_learns_off_fold(spark):
    data = [(i, f"g{i // 3}", i % 2, 0.25 + 0.4 * (i % 2) + ((i * 37) % 20) / 60, 0.2 + 0.4 * (i % 2) + ((i * 53) % 24) / 60) for i in range(240)]
    df = spark.createDataFrame(data, "sample_id int, id_measurement string, target int, p_temporal double, p_spectral double")
    oof = splits.grouped_folds(df.where("sample_id < 180"), 3, 5)
    long, components = meta.meta_fusion(oof, df.where("sample_id >= 180"))
    counts = {(r["split"], r["method"]): r["count"] for r in long.groupBy("split", "method").count().collect()}
    assert {v for (s, _), v in counts.items() if s == "train_oof"} == {180} and len(counts) == 14
    assert {v for (s, _), v in counts.items() if s == "validation"} == {60}
    assert {r[0] for r in components.select("model").collect()} == {-1, 0, 1, 2}
    assert long.where("probability < 0 OR probability > 1 OR threshold IS NULL").isEmpty()
    assert {r[0] for r in long.where("split = 'validation'").select("model").distinct().collect()} == {-1}


def test_stream_contracts(spark):
    root = st.work_path(spark, "arrivals")
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<double>").write.parquet(root)
    moments = {tuple(r) for r in st.stream_moments(st.arriving(spark, root, 1), "embedding", 2).collect()}
    assert moments == {(0, 2, 2.0, 1.0), (1, 2, 3.0, 1.0)}
    with pytest.raises(PySparkException):
        st.stream_moments(st.arriving(spark, root), "embedding", 3)
    with pytest.raises(checks.ContractError):
        st.store_stream(st.arriving(spark, root), lambda s: s, 3, ["vec_id"])


def test_wide_signals_keep_row_order_over_files(spark):
    from sigloom.sources import signals as sources

    root = st.work_path(spark, "wide")
    spark.range(10, numPartitions=1).select(F.col("id").cast("int").alias("a"), (F.col("id") * 2).cast("int").alias("b")).write.parquet(root)
    got = {r["sample_id"]: r["values"] for r in sources.read_wide_signals(spark, root, ["b", "a"], batch=1).collect()}
    assert got == {"a": [float(v) for v in range(10)], "b": [2.0 * v for v in range(10)]}
    chunks = {r["chunk"]: r["values"] for r in sources.read_wide_signals(spark, root, ["a"], chunk=4).collect()}
    assert chunks == {0: [0.0, 1.0, 2.0, 3.0], 1: [4.0, 5.0, 6.0, 7.0], 2: [8.0, 9.0]}
    with pytest.raises(checks.ContractError):
        sources.read_wide_signals(spark, root, ["c"])


def test_array_signals_reject_bad_samples(spark):
    from sigloom.sources import signals as sources

    root = st.work_path(spark, "arrays")
    spark.createDataFrame([(1, [1.0, float("nan")], 0)], "k int, v array<double>, label int").write.parquet(root)
    with pytest.raises(PySparkException):
        sources.read_array_signals(spark, root, 2, "k", "v", "train").collect()


def test_verdict_order(spark):
    schema = "checks_ok boolean, temporal double, cwt double, combined double, delta_c_given_t double, positive_seeds int, negative_seeds int"
    cases = [
        ((True, 0.65, 0.62, 0.70, 0.02, 3, 0), "TEMPORAL+CWT SUPPORTED"),
        ((True, 0.65, 0.52, 0.66, 0.006, 2, 1), "CWT COMPLEMENTARY BUT WEAKER"),
        ((True, 0.65, 0.52, 0.66, 0.001, 2, 1), "CWT REDUNDANT"),
        ((True, 0.65, 0.40, 0.66, -0.02, 0, 3), "CWT NOT SUPPORTED"),
        ((False, 0.65, 0.62, 0.70, 0.02, 3, 0), "REPRESENTATION DECOMPOSITION INCONCLUSIVE"),
    ]
    got = [r[0] for r in spark.createDataFrame([c for c, _ in cases], schema).coalesce(1).select(gates.modality_verdict()).collect()]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize("slices", [1, 5, None])
def test_ordered_prefix_over_several_slices(spark, slices):
    from sigloom.operators.ordering import ordered_prefix

    df = spark.range(500).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("o"), (F.col("id") % 11).alias("x")
    )
    got = ordered_prefix(df, ["g"], ["o"], ["x"], slices).collect()
    rows_ = sorted((r["g"], r["o"], r["x"], r["x_before"]) for r in got)
    assert len(rows_) == 500
    seen = {}
    for g, _, x, before in rows_:
        assert before == seen.get(g, 0)
        seen[g] = before + x


def test_held_out_models_equal_models_of_the_other_rows(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 14))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0.2).astype(int)
    names = [f"x{i}" for i in range(14)]
    data = [(i % 3, i % 2, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "fold int, g int, " + ", ".join(f"{n} double" for n in names) + ", target int")
    for width in (3, 14):  # plain aggregates, and blocks
        every = mo.fit_logistic(df, ["g"], names[:width], "target", balanced=True, scale=True, held_out="fold")
        found = {(r["g"], r["fold"]): r["_coef"] for r in every.table.collect()}
        assert set(found) == {(g, f) for g in (0, 1) for f in (0, 1, 2)}
        for (g, f), coef in found.items():
            alone = mo.fit_logistic(df.where(f"g = {g} AND fold <> {f}"), [], names[:width], "target", balanced=True, scale=True)
            assert np.allclose(coef, alone.table.first()["_coef"], atol=1e-6)


def test_fits_refuse_bad_features_and_unfinished_models(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(float(i % 5), int(i % 3 == 0)) for i in range(30)] + [(float("nan"), 1)], "x double, y int")
    with pytest.raises(PySparkException):
        mo.fit_logistic(df, [], ["x"], "y")
    with pytest.raises(RuntimeError):
        mo.fit_logistic(df.where("NOT isnan(x)"), [], ["x"], "y", steps=1, tolerance=1e-12)


def test_unique_keys_are_asserted(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "k int, v string")
    checks.assert_unique(df, ["k", "v"])
    with pytest.raises(checks.ContractError):
        checks.assert_unique(df, ["k"])


def test_wide_signals_of_many_columns_and_files(spark, tmp_path):
    from sigloom.sources import signals as sources

    n = 230
    for f in range(3):
        rows = [tuple(float(1000 * f + 10 * r + c % 7) for c in range(n)) for r in range(25)]
        schema = ", ".join(f"c{c} float" for c in range(n))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "wide"))
    ids = [f"c{c}" for c in range(n)]
    whole = {r["sample_id"]: r["values"] for r in sources.read_wide_signals(spark, str(tmp_path / "wide"), ids, batch=100).collect()}
    assert len(whole) == n and all(len(v) == 75 for v in whole.values())
    first = whole["c0"]
    assert sorted(first) == sorted(float(1000 * f + 10 * r) for f in range(3) for r in range(25))
    assert all(whole[f"c{c}"] == [x + c % 7 for x in first] for c in range(n))
    df = sources.read_wide_signals(spark, str(tmp_path / "wide"), ids, chunk=10)
    assert dict(df.dtypes)["values"] == "array<float>" and df.count() == n * 3 * 3
    assert {r["n"] for r in df.select("n").distinct().collect()} == {10, 5}


def test_mcnemar_is_exact_for_many_pairs(spark):
    import math

    def exact(n, k):
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(0, k - 20_000), k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    cases = [(0, 0), (1, 0), (5, 5), (3, 20), (99_000, 101_000), (98_000, 102_000), (100_000, 100_000), (15, 16), (0, 40)]
    pairs = spark.createDataFrame([(k, b, c) for k, (b, c) in enumerate(cases)], "k int, b long, c long")
    one = lambda n, a, b: pairs.select("k", F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int"))).alias("target")).select("k", "target", F.lit(a).alias("a"), F.lit(b).alias("b"))
    got = {r["k"]: r["p_value"] for r in metrics.mcnemar(one("b", 0, 1).union(one("c", 1, 0)), ["k"], "target", "a", "b").collect()}
    for k, (b, c) in enumerate(cases[1:], 1):
        assert got[k] == pytest.approx(exact(b + c, min(b, c)), rel=1e-8), (b, c)


def test_md5_draws_are_looked_up_where_the_groups_lie(spark):
    """The group table is neither sent whole to every task nor gathered in one, and the draws are those of the rule."""
    import hashlib

    n, count = 5, 4000
    df = spark.range(count).selectExpr("id AS g", "cast(id % 2 AS int) AS y", "cast(id % 3 = 0 AS int) AS a", "cast(id % 5 = 0 AS int) AS b")
    got = rs.hashed_group_replicates(df.coalesce(1), [], "g", "y", "a", "b", n)
    deltas = [r["delta"] for r in got.orderBy("replicate").collect()]
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan

    def mcc(rows, k):
        tp, tn = sum(r[0] == r[k] == 1 for r in rows), sum(r[0] == r[k] == 0 for r in rows)
        fp, fn = sum(r[0] < r[k] for r in rows), sum(r[0] > r[k] for r in rows)
        return (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))

    for r in range(n):
        took = [int(hashlib.md5(f"42|{r}|{j}".encode()).hexdigest()[:8], 16) % count for j in range(count)]
        drawn = [(i % 2, int(i % 3 == 0), int(i % 5 == 0)) for i in took]
        assert deltas[r] == pytest.approx(mcc(drawn, 1) - mcc(drawn, 2), abs=1e-12)


def test_missing_values_takes_all_orders(spark, tmp_path):
    from sigloom.plans import catalog

    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "P"), (2, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(catalog.QUERIES["missing_values"](spark, str(tmp_path)), "k") == [(3,)]


def test_select_candidate_asks_for_the_gate(spark, tmp_path):
    """Candidate 1 has the higher mean but a seed at the limit of 0.6; 2 passes."""
    from sigloom.plans import catalog

    lines = [(1, 0, 40.0, 0.05), (1, 1, 40.0, 0.05), (1, 2, 20.0, 0.03), (2, 0, 27.0, 0.05), (2, 1, 27.0, 0.05), (2, 2, 27.0, 0.05)]
    table = spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_quantity double, l_tax double")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["select_candidate"](spark, str(tmp_path)).collect()
    assert [r["candidate"] for r in got] == [2]
