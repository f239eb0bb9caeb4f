"""Chunked signals against the same operators on whole signals."""

import numpy as np
import pytest

from sigloom.functions import kernels
from sigloom.operators import chunks as ch
from sigloom.operators import streams as st
from sigloom.operators.pulses import DetectorSpec, PulsePolicy, locate_cycle, run_detector

POLICY = PulsePolicy(length=400, rate_hz=20_000.0, smoothing=31, alpha=10.0, beta=1.0)
SIZES = [7, 64, 1000]


def made(n=400):
    rng = np.random.default_rng(3)
    t = np.arange(n)
    waves = {f"wave{i}": 5 * np.sin(2 * np.pi * (t / n + i / 7)) + rng.normal(0, 1, n) for i in range(4)}
    odd = {
        "flat": np.zeros(n), "steps": np.repeat(rng.integers(0, 4, n // 8), 8).astype(float), "noise": rng.normal(0, 1, n),
        "ramp": np.linspace(-1, 1, n), "tail": np.linspace(1, -1, n), "plateau": np.concatenate([np.zeros(150), np.ones(100), np.zeros(n - 250)]),
    }
    return waves | odd


@pytest.fixture(scope="module")
def signals():
    return made()


def frame(spark, signals):
    return spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "sample_id string, values array<double>")


def together(chunks):
    rows = chunks.orderBy("chunk").select("sample_id", "chunk", "values").collect()
    out = {}
    for r in rows:
        out.setdefault(r["sample_id"], []).extend(r["values"])
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("size", SIZES)
def test_filters_equal_those_of_whole_signals(spark, signals, size):
    cut = ch.cut_signals(frame(spark, signals), size)
    assert all((together(cut)[k] == v).all() for k, v in signals.items())
    for k, v in together(ch.flatten(cut, 10.0, 1.0)).items():
        np.testing.assert_allclose(v, kernels.highpass_flatten(signals[k], 10.0, 1.0), atol=1e-9)
    for k, v in together(ch.butterworth_highpass(cut, size, 5, 900.0, 20_000.0)).items():
        np.testing.assert_allclose(v, kernels.butterworth_highpass(signals[k], 5, 900.0, 20_000.0), atol=1e-9)
    for k, v in together(ch.moving_average(cut, size, 31)).items():
        np.testing.assert_allclose(v, kernels.moving_average(signals[k], 31), atol=1e-9)


def test_states_are_composed_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, 5, 1.0, rng.normal(size=2).tolist()) for i in range(40)] + [("b", 0, 3, 2.0, [1.0, 0.0])]
    maps = spark.createDataFrame(rows, "sample_id string, step long, n long, first double, end array<double>")
    recursion = ch.Recursion(0.0, (0.9 + 0.1j,), (1.0,), steady=True)
    once, split = ({(r[0], r[1]): r[2] for r in ch.entering_states(maps, recursion, "sample_id", f).collect()} for f in (1000, 3))
    assert once.keys() == split.keys() and len(once) == 41
    for k, v in once.items():
        np.testing.assert_allclose(v, split[k], atol=1e-12)


@pytest.mark.parametrize("size", SIZES)
def test_medians_are_exact(spark, signals, size):
    rng = np.random.default_rng(5)
    more = signals | {"odd": rng.normal(size=401), "ties": rng.integers(0, 3, 777).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    got = {r[0]: r[1] for r in ch.exact_medians(ch.cut_signals(frame(spark, more), size)).collect()}
    assert got == {k: np.median(v) for k, v in more.items()}


@pytest.mark.parametrize("size", SIZES)
def test_cycle_reference_equals_that_of_whole_signals(spark, signals, size):
    more = signals | {"short": np.ones(10), "holes": np.where(np.arange(400) == 9, np.nan, 1.0)}
    names = ["success", "origin", "opposite", "half_period", "inferred", "reason"]
    got = {r["sample_id"]: tuple(r[n] for n in names) for r in ch.cycle_reference(ch.cut_signals(frame(spark, more), size), size, POLICY).collect()}
    assert got == {k: tuple(None if x is None else x for x in locate_cycle(v, POLICY, False)) for k, v in more.items()}


@pytest.mark.parametrize("size", SIZES)
def test_roll_equals_that_of_whole_signals(spark, signals, size):
    cut = ch.cut_signals(frame(spark, signals), size)
    origins = spark.createDataFrame([(k, o) for k, o in zip(signals, [0, 1, 6, 7, 63, 64, 399, None, 200, 13])], "sample_id string, origin int")
    got = together(ch.roll(cut, size, origins, 400))
    want = {r[0]: np.roll(signals[r[0]], -r[1]) for r in origins.collect() if r[1] is not None}
    assert got.keys() == want.keys() and all((got[k] == v).all() for k, v in want.items())


@pytest.mark.parametrize("size", SIZES)
def test_maxima_equal_those_of_whole_signals(spark, signals, size):
    rng = np.random.default_rng(8)
    more = signals | {"tiny": np.array([1.0, 3.0, 1.0]), "pair": np.array([1.0, 2.0]), "runs": np.repeat(rng.integers(0, 5, 60), rng.integers(1, 30, 60)).astype(float)}
    cut = ch.cut_signals(frame(spark, more), size)
    got = ch.local_maxima(cut, size).toPandas()
    for k, v in more.items():
        assert sorted(got.pos[got.sample_id == k]) == kernels.local_maxima(v).tolist()
    kept = ch.spaced_prominent(ch.local_maxima(cut, size), 5).toPandas()
    for k, v in more.items():
        tops = kernels.local_maxima(v)
        tops = tops[kernels.spaced_peaks(tops, v[tops], 5)]
        here = kept[kept.sample_id == k].sort_values("pos")
        assert here.pos.tolist() == tops.tolist()
        np.testing.assert_allclose(here.prominence.to_numpy(float), kernels.prominences(v, tops))


@pytest.mark.parametrize("size", [7, 64])
def test_highpass_detector_equals_that_of_whole_signals(spark, signals, size):
    spec = DetectorSpec("highpass", "highpass", 12, prominence_mad=1.0, keep=15, cutoff_hz=900.0)
    some = {k: v for k, v in signals.items() if k.startswith(("wave", "noise"))}
    found = ch.highpass_events(ch.cut_signals(frame(spark, some), size), size, POLICY.rate_hz, 5, 900.0, 12, 1.0, 15).toPandas()
    for k, v in some.items():
        want = run_detector(v, spec, POLICY)
        here = found[found.sample_id == k].sort_values("rank")
        assert here.pos.tolist() == want["pos"].tolist() and here.sign.tolist() == want["sign"].tolist()
        assert here.candidates.iloc[0] == want["candidates"]
        np.testing.assert_allclose(here.score, want["score"], atol=1e-9)
        np.testing.assert_allclose(here.noise, want["noise"], atol=1e-9)


def test_no_chunks_no_rows(spark):
    nothing = ch.cut_signals(spark.createDataFrame([("a", None), ("b", [])], "sample_id string, values array<double>"), 7)
    assert nothing.collect() == []
    assert ch.flatten(nothing, 10.0, 1.0).collect() == []
    assert ch.exact_medians(nothing).collect() == []
    assert ch.cycle_reference(nothing, 7, POLICY).collect() == []
    assert ch.local_maxima(nothing, 7).collect() == []
    assert ch.samples(nothing, 7).collect() == []


# Streams ----------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_peak_stream_equals_whole_signals(size):
    rng = np.random.default_rng(size)
    for x in [*made().values(), np.repeat(rng.integers(0, 5, 60), rng.integers(1, 9, 60)).astype(float), np.array([1.0, 2.0]), np.array([3.0])]:
        stream = st.PeakStream()
        for a in range(0, len(x), size):
            stream.add(x[a : a + size])
        tops = kernels.local_maxima(x)
        assert stream.pos == tops.tolist()
        for distance, least in ((1, 0.0), (5, 0.7)):
            kept = tops[kernels.spaced_peaks(tops, x[tops], distance)]
            kept = kept[kernels.prominences(x, kept) >= least] if least else kept
            assert [p for p, _ in stream.peaks(distance, least)] == kept.tolist()


def test_event_tables_match_like_arrays(spark):
    rng = np.random.default_rng(2)
    arrays = {i: (np.unique(rng.integers(0, 80, 25)), np.unique(rng.integers(0, 80, 25))) for i in range(12)}
    arrays[20] = (np.arange(0, 60), np.arange(1, 61))  # one long chain
    arrays[21] = (np.array([5]), np.array([50]))
    sides = [
        spark.createDataFrame([(k, int(p)) for k, v in arrays.items() for p in v[side]], "sample_id long, pos int") for side in (0, 1)
    ]
    pairs, rounds = st.match_event_tables(*sides, 4)
    got = {}
    for r in pairs.collect():
        got.setdefault(r["sample_id"], []).append((r["left_pos"], r["right_pos"] - r["left_pos"]))
    for k, (a, b) in arrays.items():
        assert [o for _, o in sorted(got.get(k, []))] == kernels.match_offsets(a, b, 4)
    assert rounds >= 1
    summary = {r["sample_id"]: r for r in st.match_summary(*sides, pairs).collect()}
    assert summary[21]["matched"] == 0 and np.isnan(summary[21]["median_offset"]) and summary[20]["matched"] == 60
    assert st.match_event_tables(sides[0].limit(0), sides[1], 4)[0].collect() == []


# Batches of short chunks ------------------------------------------------------------------


def test_maxima_make_no_frame_for_a_chunk(spark, signals, monkeypatch):
    """A batch of many chunks is one array: what a task does by chunk is no table of its own."""
    cut = ch.cut_signals(frame(spark, signals), 7)
    found = []
    monkeypatch.setattr(type(cut), "mapInArrow", lambda self, f, schema, *a, **k: found.append((f, schema)) or self.sparkSession.createDataFrame([], schema))
    ch.local_maxima(cut, 7)
    batch = cut.select("sample_id", "chunk", "values").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(ch.pd, "DataFrame", None)
    rows = sum(out.num_rows for out in found[0][0](iter([batch])))
    assert rows >= 2 * len(signals)


def test_streams_take_a_signal_of_a_batch_at_once(spark, signals, monkeypatch):
    """Not a call for each sample; a signal goes on in the next batch."""
    rows = ch.samples(ch.cut_signals(frame(spark, signals), 64), 64)
    want = {(k, p): s for k, v in signals.items() for p, s in zip(kernels.local_maxima(v).tolist(), v[kernels.local_maxima(v)])}
    assert {(r[0], r[1]): r[2] for r in st.stream_peaks(rows, "pos", "value").collect()} == want
    found, calls, add = [], [], st.PeakStream.add
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *a, **k: found.append(f) or self.sparkSession.createDataFrame([], schema))
    monkeypatch.setattr(st.PeakStream, "add", lambda self, x: calls.append(len(x)) or add(self, x))
    st.stream_peaks(rows, "pos", "value")
    table = rows.orderBy("sample_id", "pos").selectExpr("sample_id AS key", "pos AS place", "value AS values", "0D AS noise").toArrow()
    out = [r for b in found[0](iter(table.combine_chunks().to_batches(max_chunksize=150))) for r in b.to_pylist()]
    assert {(r["key"], r["pos"]): r["score"] for r in out} == want
    assert sum(calls) == 4000 and len(calls) <= len(signals) + 4000 // 150 + 1


def test_rows_of_a_batch_go_through_a_recursion_together():
    rng = np.random.default_rng(4)
    _, poles, residues = kernels._highpass_branches(3, 900.0, 20_000.0)
    for recursion in (ch.Recursion(1.0, (0.9,), (0.1,)), ch.Recursion(0.5, poles, residues, steady=True)):
        for n in (1, 7, 300, ch.PIECE + 5):
            x = rng.normal(size=(4, n))
            start = recursion.starts(x[:, 0])
            each = [[kernels.first_order(row, complex(p), complex(r), s) for p, r, s in zip(recursion.poles, recursion.residues, at)] for row, at in zip(x, start)]
            np.testing.assert_allclose(recursion.branches(x, start), np.sum(each, axis=1).real, atol=1e-9)
            ends = [[kernels.first_order(row, complex(p), complex(r))[-1] for p, r in zip(recursion.poles, recursion.residues)] for row in x]
            np.testing.assert_allclose(recursion.ends(x), ends, atol=1e-9)


def test_groups_come_many_at_a_time_and_whole(spark, monkeypatch):
    import pyarrow as pa

    from sigloom.functions import batches

    df, found, calls = spark.createDataFrame([], "k string, v long"), [], []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema, *a, **k: found.append(f) or self)
    batches.whole_groups(df, ["k"], "k string", lambda b, begins: calls.append((b, begins.tolist())) or b)
    keys = ["a"] * 3 + [None] * 2 + ["b"] * 9 + [*"cdefg"]
    table = pa.table({"k": keys, "v": list(range(len(keys)))})
    got = [r for b in found[0](iter(table.to_batches(max_chunksize=4))) for r in b.to_pylist()]
    assert [r["v"] for r in got] == list(range(len(keys)))
    groups = [b.column("k")[a].as_py() for b, begins in calls for a in begins[:-1]]
    assert groups == ["a", None, "b", *"cdefg"] and len(calls) < len(groups)
