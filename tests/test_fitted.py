"""Boosted trees, perceptrons and stop sets against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import boosting as bo
from sigloom.operators import networks as nw
from sigloom.operators import splits as sp
from sigloom.operators.blocks import Fit, to_blocks, unpack

FEATURES = ["a", "b", "c"]
SCHEMA = "sample_id long, fold int, target int, a double, b double, c double, tag string"


def rows(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * (x[:, 1] > 0.3) + x[:, 0] * x[:, 2])))).astype(int)
    return [(i, i % 3, int(y[i]), *map(float, x[i]), f"t{i}") for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


class PlainBoosting:
    """Every split tried on every row, one model at a time."""

    def __init__(self, spec, edges):
        self.spec, self.edges = spec, edges

    def leaf(self, g, h):
        return -self.spec.rate * g / (h + self.spec.l2)

    def fit(self, x, y, train):
        s = self.spec
        codes = [[int(np.searchsorted(e, v)) for v, e in zip(row, self.edges)] for row in x]
        inside = [i for i in range(len(x)) if train[i]]
        p = sum(y[i] for i in inside)
        if p in (0, len(inside)):
            return [40.0 if p else -40.0] * len(x)
        score = [math.log(p / (len(inside) - p))] * len(x)
        for _ in range(s.trees):
            g = [1 / (1 + math.exp(-score[i])) - y[i] for i in range(len(x))]
            h = [(g[i] + y[i]) * (1 - g[i] - y[i]) for i in range(len(x))]
            tree = {0: (list(range(len(x))), None)}
            leaves, level = 1, [0]
            for _ in range(s.depth):
                found = []
                for node in level:
                    members = [i for i in tree[node][0] if train[i]]
                    best = None
                    total = (sum(g[i] for i in members), sum(h[i] for i in members))
                    for f in range(len(self.edges)):
                        for b in range(s.bins - 1):
                            left = [i for i in members if codes[i][f] <= b]
                            lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                            rg, rh = total[0] - lg, total[1] - lh
                            if min(len(left), len(members) - len(left)) < s.min_rows or min(lh, rh) < s.min_curvature:
                                continue
                            gain = lg**2 / (lh + s.l2) + rg**2 / (rh + s.l2) - total[0] ** 2 / (total[1] + s.l2)
                            if best is None or gain > best[0] + 1e-11:
                                best = (gain, f, b)
                    if best and best[0] > 1e-12:
                        found.append((best, node))
                found.sort(key=lambda x: (-x[0][0], x[1]))
                level = []
                for (_, f, b), node in found[: s.leaves - leaves]:
                    members = tree[node][0]
                    parts = [i for i in members if codes[i][f] <= b], [i for i in members if codes[i][f] > b]
                    for child, part in zip((2 * node + 1, 2 * node + 2), parts):
                        tree[child] = (part, None)
                        if sum(train[i] for i in part) >= 2 * s.min_rows:
                            level.append(child)
                    tree[node] = (members, (f, b))
                    leaves += 1
                level.sort()
                if leaves >= s.leaves:
                    break
            for members, split in tree.values():
                if split is None:
                    inner = [i for i in members if train[i]]
                    value = self.leaf(sum(g[i] for i in inner), sum(h[i] for i in inner))
                    for i in members:
                        score[i] += value
        return score


def test_boosting_equals_plain_python(spark):
    data = rows()
    spec = bo.BoostSpec(trees=3, rate=0.3, leaves=6, l2=1.0, bins=8, min_rows=10, checkpoint=2)
    df = frame(spark, data)
    fits = [Fit(tuple(FEATURES), F.col("fold") != 0), Fit(("a", "c"), F.lit(True)), Fit(tuple(FEATURES), F.col("target") == 1), Fit(("b",), F.lit(False))]
    scored, model = bo.fit_boosted(df, "sample_id", "target", fits, spec)
    got = {r["sample_id"]: r["scores"] for r in scored.collect()}
    x, y = [d[3:6] for d in data], [d[2] for d in data]
    plain = PlainBoosting(spec, model.edges)
    want = [
        plain.fit(x, y, [d[1] != 0 for d in data]),
        PlainBoosting(spec, [model.edges[0], model.edges[2]]).fit([(r[0], r[2]) for r in x], y, [True] * len(data)),
    ]
    for m, scores in enumerate(want):
        np.testing.assert_allclose([got[i][m] for i in range(len(data))], 1 / (1 + np.exp(-np.array(scores))), atol=1e-12)
    assert all(got[i][2] > 0.999 and got[i][3] < 0.001 for i in got)
    again = {r["sample_id"]: r["scores"] for r in model.score(df).collect()}
    np.testing.assert_allclose([again[i] for i in sorted(again)], [got[i] for i in sorted(got)], atol=1e-12)


def test_boosted_held_out_rows_do_not_change_their_model(spark):
    data = rows(240, 5)
    spec = bo.BoostSpec(trees=5, rate=0.2, bins=16)
    base = {r["sample_id"]: r["probability"] for r in bo.cross_fit_boosted(frame(spark, data), FEATURES, spec=spec).collect()}
    flipped = [(*d[:2], 1 - d[2], *d[3:]) if d[1] == 1 else d for d in data]
    other = {r["sample_id"]: r["probability"] for r in bo.cross_fit_boosted(frame(spark, flipped).repartition(5), FEATURES, spec=spec).collect()}
    assert all(base[d[0]] == other[d[0]] for d in data if d[1] == 1)
    assert any(base[d[0]] != other[d[0]] for d in data if d[1] != 1)
    auc = np.mean([(base[a[0]] > base[b[0]]) for a in data if a[2] for b in data if not b[2]])
    assert auc > 0.75


def test_blocks_keep_every_row_and_column(spark):
    data = rows(50)
    df = frame(spark, data).withColumn("more", F.array("a", "b"))
    fits = [Fit(("a",), F.lit(True)), Fit(("b", "a"), F.col("fold") == 1, F.col("fold") == 2)]
    blocks = to_blocks(df, "sample_id", "target", fits, block_rows=7)
    assert blocks.table.agg(F.max("rows"), F.sum("rows")).first() == (7, 50)
    again = to_blocks(df.repartition(6), "sample_id", "target", fits, block_rows=7)
    assert sorted(r["x"] for r in blocks.table.collect()) == sorted(r["x"] for r in again.table.collect())
    same = blocks.table.withColumn("score", F.lit(np.zeros(0).tobytes()))
    whole = unpack(same.where("rows = 0"), blocks)
    assert whole.columns == [*df.columns, "scores"]
    bad = df.withColumn("a", F.when(F.col("sample_id") == 3, F.lit(float("nan"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="not finite"):
        to_blocks(bad, "sample_id", "target", fits)


def test_network_gradient():
    rng = np.random.default_rng(1)
    spec = nw.NetworkSpec(hidden=(5, 4))
    shapes = spec.shapes(3)
    w, x, y = spec.start(3), rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    slope, loss = nw.gradient(x, y, w, shapes)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (nw.gradient(x, y, w + s, shapes)[1] for s in (step, -step))
        assert abs((up - down) / 2e-6 - slope[i]) < 1e-4
    assert loss == pytest.approx(nw.losses(nw.forward(x, w, shapes)[-1][:, 0], y).sum())


def test_networks_do_not_depend_on_partitions_and_learn(spark):
    data = rows(400, 3)
    df = frame(spark, data)
    stops = sp.stop_sets(df, "fold", 0.2, 7)
    marked = sp.with_stop_sets(df, stops)
    spec = nw.NetworkSpec(hidden=(6, 4), steps=60)
    runs = [
        {r["sample_id"]: r["probability"] for r in nw.cross_fit_networks(marked.repartition(n), FEATURES, spec=spec, stop_in="stop_in").collect()}
        for n in (1, 8)
    ]
    assert runs[0] == runs[1]
    auc = np.mean([(runs[0][a[0]] > runs[0][b[0]]) for a in data if a[2] for b in data if not b[2]])
    assert auc > 0.75


def test_stop_rows_choose_the_step(spark):
    """Stop rows with the opposite classes end the fit at once; the weights that were best stay."""
    data = rows(200, 9)
    df = frame(spark, [(*d[:2], 1 - d[2] if d[1] == 2 else d[2], *d[3:]) for d in data])
    spec = nw.NetworkSpec(hidden=(4,), steps=80, patience=5)
    _, nets = nw.fit_networks(df, "sample_id", "target", [
        Fit(tuple(FEATURES), F.col("fold") < 2), Fit(tuple(FEATURES), F.col("fold") < 2, F.col("fold") == 2), Fit(("a",), F.col("target") == 0),
    ], spec)
    free, stopped, constant = nets.models
    assert stopped.passes < free.passes
    assert stopped.least == min(stopped.history) and stopped.history.index(stopped.least) == stopped.passes - 1 - spec.patience
    x = np.array([d[3:6] for d in data if d[1] == 2])
    y = np.array([1.0 - d[2] for d in data if d[1] == 2])
    assert nw.losses(nets.logits(x, 1), y).mean() == pytest.approx(stopped.least)
    assert constant.done and nets.constant[2] == 0.0


def test_stop_sets_stay_outside_their_fold(spark):
    data = rows(100)
    df = frame(spark, data)
    out = sp.stop_sets(df, "fold", 0.1, 3).collect()
    fold, target = {d[0]: d[1] for d in data}, {d[0]: d[2] for d in data}
    assert len(out) == 200 and all(fold[r["sample_id"]] != r["outer_fold"] for r in out)
    for f in range(3):
        for t in range(2):
            members = [r for r in out if r["outer_fold"] == f and target[r["sample_id"]] == t]
            assert sum(r["stop"] for r in members) == round(0.1 * len(members))
    grouped = sp.stop_sets(df.withColumn("g", F.expr("sample_id div 6")).withColumn("fold", F.expr("cast(g % 3 as int)")), "fold", 0.3, 3, "g")
    assert grouped.groupBy("g", "outer_fold").count().where("count > 1").count() == 0


def test_linear_models_equal_those_of_keys(spark):
    from sigloom.operators import linear as ln
    from sigloom.operators import models as mo

    df = frame(spark, rows(200, 2))
    fits = [Fit(tuple(FEATURES), F.col("fold") != f) for f in range(3)] + [Fit(("b",), F.lit(True)), Fit(("a",), F.col("target") == 1)]
    scored, _ = ln.fit_linear(df, "sample_id", "target", fits)
    got = {r["sample_id"]: (r["scores"], r["fold"]) for r in scored.collect()}
    for r in mo.stacking(df, FEATURES).collect():
        scores, fold = got[r["sample_id"]]
        assert scores[fold] == pytest.approx(r["probability"], abs=1e-9) and scores[4] > 0.999
    one = mo.fit_predict(df, df, ["b"], "logistic", 0)
    assert all(got[r["sample_id"]][0][3] == pytest.approx(r["probability"], abs=1e-9) for r in one.collect())


def test_moments_keep_their_digits_far_from_zero(spark):
    from sigloom.operators import signals as sg

    rng = np.random.default_rng(6)
    x = 1e6 + rng.normal(0, 1e-3, (100, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "values array<double>").repartition(7)
    got = {r["pos"]: r for r in sg._merged_moments(df, "values", True).collect()}
    for i in range(3):
        assert got[i]["n"] == 100
        assert math.sqrt(got[i]["variance"]) == pytest.approx(x[:, i].std(), abs=1e-9)
    whole = sg.fit_scalar_standardizer(df).first()
    assert whole["std"] == pytest.approx(x.std(), abs=1e-9) and whole["n"] == 300


def test_boosting_folds_rows_of_equal_bins(spark, monkeypatch):
    """3,000 rows of 12 kinds are 12 cells in every pass, and each row has the score of its kind."""
    seen = []
    grow = bo._grow
    monkeypatch.setattr(bo, "_grow", lambda state, *rest: (seen.append(state.agg(F.sum("rows")).first()[0]), grow(state, *rest)))
    df = spark.range(3000).selectExpr("id", "cast(id % 6 AS double) AS x", "cast(id % 4 >= 2 AS int) AS y")
    scored, model = bo.fit_boosted(df, "id", "y", [Fit(("x",), F.col("id") % 5 != 0), Fit(("x",), F.col("id") % 5 != 1)], bo.BoostSpec(trees=3))
    assert set(seen) == {12}
    got, plain = ({r["id"]: r["s"] for r in t.select("id", F.col(n).alias("s")).collect()} for t, n in ((scored, "scores"), (model.score(df, "again"), "again")))
    assert len(got) == 3000 and scored.columns == ["id", "x", "y", "scores"]
    assert all(abs(a - b) < 1e-12 for k in got for a, b in zip(got[k], plain[k]))


def test_tasks_hold_several_blocks_of_a_large_table(spark):
    from sigloom.operators.blocks import model_moments, partitions

    assert [partitions(n) for n in (0, 8192, 8193, 600_000, 6_000_000)] == [1, 1, 2, 64, 92]
    df = spark.range(3000).selectExpr("id", "cast(id AS double) AS x", "cast(id % 2 AS int) AS y")
    blocks = to_blocks(df, "id", "y", [Fit(("x",), F.col("id") % 3 == 0)], block_rows=4)
    assert blocks.parts == 94 and blocks.table.agg(F.sum("rows")).first()[0] == 3000
    got = model_moments(blocks)[0]
    assert (got["n"], got["p"], got["mean"][0]) == (1000, 500, pytest.approx(1498.5))


def test_trees_of_a_model_in_one_tile_take_no_passes(spark, monkeypatch):
    """More trees start no more jobs; the passes over several tiles give the same scores."""
    df = frame(spark, rows(400, 4))
    fits = [Fit(tuple(FEATURES), F.col("fold") != 0), Fit(("c", "a"), F.lit(True)), Fit(("b",), F.col("target") == 1), Fit(("b",), F.lit(False))]

    def run(trees):
        group = f"trees {trees} {bo.TILE_CELLS}"
        spark.sparkContext.setJobGroup(group, group)
        scored, _ = bo.fit_boosted(df, "sample_id", "target", fits, bo.BoostSpec(trees=trees, rate=0.3, leaves=6, bins=16, min_rows=5))
        got = {r["sample_id"]: r["scores"] for r in scored.collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return got, jobs

    (_, few), (whole, many) = run(1), run(4)
    assert few == many > 0
    monkeypatch.setattr(bo, "TILE_CELLS", 50)
    monkeypatch.setattr(bo, "CELL_ROWS", 60)
    split, passes = run(4)
    assert passes > many + 4
    for k, scores in whole.items():
        np.testing.assert_allclose(split[k], scores, atol=1e-12)


def test_networks_fold_rows_of_equal_features(spark, monkeypatch):
    """3,000 rows of 12 kinds are 12 cells in every pass, with the steps of all rows."""
    seen = []
    one = nw._pass
    monkeypatch.setattr(nw, "_pass", lambda blocks, nets: (seen.append(blocks.table.agg(F.sum("rows")).first()[0]), one(blocks, nets))[1])
    df = spark.range(3000).selectExpr("id", "cast(id % 6 AS double) AS x", "cast(id % 4 >= 2 AS int) AS y")
    spec = nw.NetworkSpec(hidden=(3,), steps=4)
    fits = [Fit(("x",), F.col("id") % 5 != 0), Fit(("x",), F.col("id") % 5 < 3, F.col("id") % 5 == 3)]
    scored, nets = nw.fit_networks(df, "id", "y", fits, spec)
    assert len(seen) == 4 and set(seen) == {12}
    ids = np.arange(3000)
    x, y, shapes = (ids % 6).astype(float)[:, None], (ids % 4 >= 2).astype(float), spec.shapes(1)
    got = {r["id"]: r["scores"] for r in scored.collect()}
    for m, (train, stop) in enumerate([(ids % 5 != 0, None), (ids % 5 < 3, ids % 5 == 3)]):
        z = (x - x[train].mean()) / x[train].std()
        start = spec.start(1)
        plain = nw.Training(start, np.full(len(start), spec.first_step), np.zeros(len(start)), start)
        while not plain.done:
            slope, loss = nw.gradient(z[train], y[train], plain.weights, shapes)
            decay = nw.penalised(plain.weights, shapes) * spec.alpha
            own = (loss + 0.5 * float(decay @ plain.weights)) / train.sum()
            held = own if stop is None else nw.losses(nw.forward(z[stop], plain.weights, shapes)[-1][:, 0], y[stop]).mean()
            plain.move((slope + decay) / train.sum(), float(held), spec)
        np.testing.assert_allclose(nets.models[m].history, plain.history, atol=1e-12)
        want = 1 / (1 + np.exp(-nw.forward(z, plain.best, shapes)[-1][:, 0]))
        np.testing.assert_allclose([got[i][m] for i in range(3000)], want, atol=1e-9)


def test_stop_sets_order_every_row_once(spark, monkeypatch):
    """One order of 300 rows serves all outer folds, with the ranks of each fold's own order."""
    ordered = []
    prefix = sp.ordered_prefix
    monkeypatch.setattr(sp, "ordered_prefix", lambda df, *rest: (ordered.append(df.count()), prefix(df, *rest))[1])
    df = frame(spark, rows(300))
    got = {(r["outer_fold"], r["sample_id"]): r["stop"] for r in sp.stop_sets(df, "fold", 0.2, 42).collect()}
    assert ordered == [300]
    data = df.select("sample_id", "fold", "target", sp.hash32(42, "sample_id").alias("h")).collect()
    for outer in range(3):
        for target in range(2):
            members = sorted((r["h"], r["sample_id"]) for r in data if r["fold"] != outer and r["target"] == target)
            assert [got.pop((outer, k)) for _, k in members] == [i < round(0.2 * len(members)) for i in range(len(members))]
    assert not got
    assert sp.stop_sets(df.limit(0), "fold", 0.2, 42).count() == 0
