"""Signals cut into chunks: the same results as from whole signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import chunks as ch
from sigloom.operators import pulses as pu
from sigloom.operators import streams as st
from sigloom.plans import inputs as src
from sigloom.plans.registry import query, rounded
from sigloom.plans.signal_queries import CURRENT, MATCH_SQL, PEAKS_SQL, POLICY, ROLLED, reference_sql, sig, smooth_sql

SIZES = (7, 64)
EACH_SIZE = f"(VALUES {', '.join(f'({s})' for s in SIZES)}) z(size)"


def each_size(spark, sf, work):
    """The rows of ``work(chunks, size)`` for every chunk size, with the size."""
    out = None
    for size in SIZES:
        part = work(ch.cut_signals(sig(spark, sf), size), size).withColumn("size", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(
    "chunked_flatten",
    f"""WITH {src.SIGNALS}, fl AS (SELECT a.sample_id, a.i, a.v - sum(0.1*power(0.9, a.i-b.i)*b.v) AS x FROM samples a JOIN samples b ON a.sample_id=b.sample_id AND b.i <= a.i GROUP BY a.sample_id, a.i, a.v)
    SELECT sample_id, i AS pos, round(x,6) AS value, size FROM fl, {EACH_SIZE}""",
)
def chunked_flatten(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.samples(ch.flatten(c, 10.0, 1.0), size))


@query(
    "chunked_moving_average",
    f"""WITH {src.SIGNALS}, {smooth_sql(8, 8)} SELECT sample_id, i AS pos, round(s,6) AS value, size FROM sm, {EACH_SIZE}""",
)
def chunked_moving_average(spark, sf):
    """Seventeen samples, so that chunks of seven need those of several others."""
    return each_size(spark, sf, lambda c, size: ch.samples(ch.moving_average(c, size, 17), size))


@query("chunked_median", f"WITH {src.SIGNALS} SELECT sample_id, round(median(v),6) AS median, size FROM samples, {EACH_SIZE} GROUP BY sample_id, size")
def chunked_median(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.exact_medians(c))


@query(
    "chunked_cycle_reference",
    f"""WITH {src.SIGNALS}, {reference_sql(True)}, {CURRENT} SELECT sample_id, success, origin, opposite, inferred, size FROM cur, {EACH_SIZE}""",
)
def chunked_cycle_reference(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.cycle_reference(c, size, POLICY).select("sample_id", "success", "origin", "opposite", "inferred"))


@query(
    "chunked_alignment",
    f"""WITH {src.SIGNALS}, {ROLLED} SELECT sample_id, i AS pos, round(x,6) AS value, size FROM fl, {EACH_SIZE}""",
)
def chunked_alignment(spark, sf):
    """Rolled to the cycle's origin and flattened, chunk by chunk."""

    def work(c, size):
        cycle = ch.cycle_reference(c, size, POLICY).where("success")
        return ch.samples(ch.flatten(ch.roll(c, size, cycle, 64), 10.0, 1.0), size)

    return each_size(spark, sf, work)


@query(
    "chunked_local_maxima",
    f"""WITH {src.SIGNALS}, l AS (SELECT sample_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY sample_id ORDER BY i))
    SELECT sample_id, i AS pos, round(v,6) AS height, size FROM l, {EACH_SIZE} WHERE v > a AND v > b""",
)
def chunked_local_maxima(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.local_maxima(c, size).select("sample_id", "pos", "height"))


ORDER, CUTOFF, RATE, DISTANCE, MAD, KEEP = 5, 400.0, 3200.0, 5, 1.0, 8


def _transfer() -> tuple[list[float], list[float], list[float]]:
    """Numerator, denominator and steady state of the filter as one difference equation."""
    k = np.arange(ORDER)
    warped = 2 * RATE * np.tan(np.pi * CUTOFF / RATE) / np.exp(1j * np.pi * (2 * k + ORDER + 1) / (2 * ORDER))
    poles = (2 * RATE + warped) / (2 * RATE - warped)
    b = np.real(np.prod(2 * RATE / (2 * RATE - warped))) * np.poly(np.ones(ORDER))
    return b.tolist(), np.real(np.poly(poles)).tolist(), (-np.cumsum(b)[:-1]).tolist()


def highpass_sql() -> str:
    """``hp`` (sample_id, i, v): forward and backward difference equation over the odd extension."""
    b, a, z = _transfer()
    pad = 3 * (ORDER + 1)
    number = lambda x: f"{x!r}::DOUBLE"

    def sweep(name: str, source: str) -> str:
        y = f"({number(b[0])}*e[i+1] + z[1])"
        state = ", ".join(f"{number(b[j])}*e[i+1] - {number(a[j])}*y + {f'z[{j + 1}]' if j < ORDER else '0'}" for j in range(1, ORDER + 1))
        return f"""{name} AS (SELECT sample_id, e, 0 AS i, [{', '.join(f'{number(v)}*e[1]' for v in z)}] AS z, CAST([] AS DOUBLE[]) AS out FROM {source}
      UNION ALL SELECT sample_id, e, i+1, [{state}], list_append(out, y) FROM (SELECT *, {y} AS y FROM {name} WHERE i < len(e)))"""

    return f"""ga AS (SELECT sample_id, vals AS g, len(vals) AS n FROM signals),
    ex AS (SELECT sample_id, list_concat(list_concat(list_transform(range({pad}, 0, -1), lambda k: 2*g[1] - g[k+1]), g), list_transform(range(1, {pad + 1}), lambda k: 2*g[n] - g[n-k])) AS e FROM ga),
    {sweep('fw', 'ex')},
    re AS (SELECT sample_id, list_reverse(out) AS e FROM fw WHERE i = len(e)),
    {sweep('bw', 're')},
    hl AS (SELECT sample_id, list_reverse(out)[{pad + 1} : len(e) - {pad}] AS y FROM bw WHERE i = len(e)),
    hp AS (SELECT sample_id, generate_subscripts(y, 1) - 1 AS i, unnest(y) AS v FROM hl)"""


@query("chunked_highpass", f"WITH RECURSIVE {src.SIGNALS}, {highpass_sql()} SELECT sample_id, i AS pos, round(v,6) AS value, size FROM hp, {EACH_SIZE}")
def chunked_highpass(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.samples(ch.butterworth_highpass(c, size, ORDER, CUTOFF, RATE), size))


EVENTS_SQL = f"""
  md AS (SELECT sample_id, median(v) AS c, stddev_pop(v) AS sd FROM hp GROUP BY 1),
  ce AS (SELECT sample_id, i, v - c AS x, abs(v - c) AS h, sd FROM hp JOIN md USING (sample_id)),
  nz AS (SELECT sample_id, greatest(1.4826*median(h), 0.05*max(sd), 1e-6) AS noise FROM ce GROUP BY 1),
  pk AS (SELECT * FROM (SELECT *, lag(h) OVER w AS a, lead(h) OVER w AS b FROM ce WINDOW w AS (PARTITION BY sample_id ORDER BY i)) WHERE h > a AND h > b),
  gr AS (SELECT sample_id, list({{'i': i, 'h': h}} ORDER BY h DESC, i DESC) AS rest, CAST([] AS STRUCT(i BIGINT, h DOUBLE)[]) AS kept FROM pk GROUP BY sample_id
    UNION ALL SELECT sample_id, list_filter(rest, lambda x: abs(x.i - rest[1].i) >= {DISTANCE}), list_append(kept, rest[1]) FROM gr WHERE len(rest) > 0),
  kp AS (SELECT sample_id, k.i AS p, k.h AS h FROM (SELECT sample_id, unnest(kept) AS k FROM gr WHERE len(rest) = 0)),
  ed AS (SELECT k.sample_id, p, k.h, coalesce(max(i) FILTER (i < p AND s.h > k.h), -1) AS lo, coalesce(min(i) FILTER (i > p AND s.h > k.h), 1000000) AS hi FROM kp k JOIN ce s ON s.sample_id = k.sample_id GROUP BY k.sample_id, p, k.h),
  pr AS (SELECT e.sample_id, p, e.h, e.h - greatest(min(s.h) FILTER (i > lo AND i <= p), min(s.h) FILTER (i < hi AND i >= p)) AS prominence FROM ed e JOIN ce s ON s.sample_id = e.sample_id GROUP BY e.sample_id, p, e.h),
  ok AS (SELECT pr.*, noise, count(*) OVER (PARTITION BY sample_id) AS candidates, row_number() OVER (PARTITION BY sample_id ORDER BY h DESC, p) AS rank FROM pr JOIN nz USING (sample_id) WHERE prominence >= {MAD} * noise)"""
HIGHPASS_EVENTS = f"{highpass_sql()}, {EVENTS_SQL}"


@query(
    "chunked_highpass_events",
    f"""WITH RECURSIVE {src.SIGNALS}, {HIGHPASS_EVENTS}
    SELECT ok.sample_id, round(noise,6) AS noise, candidates, CAST(rank AS INT) AS rank, p AS pos, round(ok.h,6) AS score, CAST(sign(x) AS INT) AS sign, size
    FROM ok JOIN ce ON ce.sample_id = ok.sample_id AND ce.i = ok.p, {EACH_SIZE} WHERE rank <= {KEEP}""",
)
def chunked_highpass_events(spark, sf):
    return each_size(spark, sf, lambda c, size: ch.highpass_events(c, size, RATE, ORDER, CUTOFF, DISTANCE, MAD, KEEP))


@query(
    "detect_highpass",
    f"""WITH RECURSIVE {src.SIGNALS}, {HIGHPASS_EVENTS}
    SELECT ok.sample_id, round(noise,6) AS noise, CAST(candidates AS INT) AS candidates, CAST(rank AS INT) AS rank, CAST(p AS INT) AS pos, round(ok.h,6) AS score, CAST(sign(x) AS INT) AS sign
    FROM ok JOIN ce ON ce.sample_id = ok.sample_id AND ce.i = ok.p WHERE rank <= {KEEP}""",
)
def detect_highpass(spark, sf):
    """The registered high-pass detector on whole signals, with the events of each."""
    spec = pu.DetectorSpec("highpass", "highpass", DISTANCE, prominence_mad=MAD, keep=KEEP, cutoff_hz=CUTOFF, order=ORDER)
    found = pu.detect_events(sig(spark, sf), [spec], POLICY)
    events = found.select("sample_id", "noise", "candidates", F.posexplode("peaks").alias("rank", "p"))
    return rounded(events.select("sample_id", "noise", "candidates", (F.col("rank") + 1).alias("rank"), "p.pos", "p.score", "p.sign"))


WINDOW, DEGREE = 9, 3


def _hat() -> str:
    """What each sample of a window weighs in the polynomial's value at each of its places."""
    basis = np.vander(np.arange(WINDOW) - WINDOW // 2, DEGREE + 1, increasing=True).astype(float)
    q, _ = np.linalg.qr(basis)
    return ", ".join(f"({r}, {j}, {c!r}::DOUBLE)" for r, row in enumerate((q @ q.T).tolist()) for j, c in enumerate(row))


@query(
    "detect_polynomial",
    f"""WITH RECURSIVE {src.SIGNALS}, hat AS (SELECT * FROM (VALUES {_hat()}) t(r, j, c)),
    pl AS (SELECT sample_id, i, v, least(greatest(i - {WINDOW // 2}, 0), 64 - {WINDOW}) AS s FROM samples),
    hp AS (SELECT a.sample_id, a.i, a.v - sum(hat.c * b.v) AS v FROM pl a JOIN hat ON hat.r = a.i - a.s JOIN samples b ON b.sample_id = a.sample_id AND b.i = a.s + hat.j GROUP BY a.sample_id, a.i, a.v),
    {EVENTS_SQL}
    SELECT ok.sample_id, round(noise,6) AS noise, CAST(candidates AS INT) AS candidates, CAST(rank AS INT) AS rank, CAST(p AS INT) AS pos, round(ok.h,6) AS score, CAST(sign(x) AS INT) AS sign
    FROM ok JOIN ce ON ce.sample_id = ok.sample_id AND ce.i = ok.p WHERE rank <= {KEEP}""",
)
def detect_polynomial(spark, sf):
    """The registered detector over a sliding polynomial, with the events of each signal."""
    spec = pu.DetectorSpec("polynomial", "polynomial", DISTANCE, prominence_mad=MAD, keep=KEEP, window=WINDOW, degree=DEGREE)
    found = pu.detect_events(sig(spark, sf), [spec], POLICY)
    events = found.select("sample_id", "noise", "candidates", F.posexplode("peaks").alias("rank", "p"))
    return rounded(events.select("sample_id", "noise", "candidates", (F.col("rank") + 1).alias("rank"), "p.pos", "p.score", "p.sign"))


@query(
    "detect_strict",
    f"""WITH {src.SIGNALS}, {reference_sql(False)}, st AS (SELECT sample_id, o AS origin FROM al WHERE abs(sep-32) <= 8),
    ro AS (SELECT s.sample_id, (i - origin + 64) % 64 AS i, v, origin FROM samples s JOIN st USING (sample_id)),
    fl AS (SELECT a.sample_id, a.i, a.v, a.origin, a.v - sum(0.1*power(0.9, a.i-b.i)*b.v) AS x FROM ro a JOIN ro b ON a.sample_id=b.sample_id AND b.i <= a.i GROUP BY a.sample_id, a.i, a.v, a.origin),
    md AS (SELECT sample_id, median(x) AS c FROM fl GROUP BY 1), nz AS (SELECT sample_id, greatest(1.4826*median(abs(x-c)), 1e-6) AS noise FROM fl JOIN md USING (sample_id) GROUP BY 1),
    pk AS (SELECT * FROM (SELECT *, lag(abs(x)) OVER w AS b, lead(abs(x)) OVER w AS n FROM fl WINDOW w AS (PARTITION BY sample_id ORDER BY i)) WHERE abs(x) > b AND abs(x) > n),
    rk AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS candidates, row_number() OVER (PARTITION BY sample_id, i // 32 ORDER BY abs(x) DESC, i) AS r FROM pk)
    SELECT sample_id, round(noise,6) AS noise, CAST(candidates AS INT) AS candidates, CAST((i + origin) % 64 AS INT) AS pos, round(abs(x),6) AS score, CAST(sign(v) AS INT) AS sign
    FROM rk JOIN nz USING (sample_id) WHERE r <= 4""",
)
def detect_strict(spark, sf):
    """The registered strict-cycle detector, with the events of each signal whose cycle is found."""
    found = pu.detect_events(sig(spark, sf), [pu.DetectorSpec("strict", "strict", 1, keep=4)], POLICY).where("success")
    events = found.select("sample_id", "noise", "candidates", F.explode("peaks").alias("p"))
    return rounded(events.select("sample_id", "noise", "candidates", "p.pos", "p.score", "p.sign"))


# Streams of samples and events ----------------------------------------------------------


def _mad(chunks):
    """key, noise: 1.4826 times the median distance from the median."""
    middle = ch.exact_medians(chunks)
    apart = chunks.join(middle, "sample_id").withColumn("values", F.transform("values", lambda x: F.abs(x - F.col("median")))).drop("median")
    return ch.exact_medians(apart).select("sample_id", (F.col("median") * 1.4826).alias("noise"))


@query("stream_peaks", f"WITH RECURSIVE fp AS ({PEAKS_SQL}) SELECT fp.*, kind FROM fp, (VALUES ('samples'), ('chunks')) k(kind)")
def stream_peaks(spark, sf):
    """``find_peaks`` from rows of single samples and from rows of chunks."""
    chunks = ch.cut_signals(sig(spark, sf), 7)
    noise = _mad(chunks)
    single = st.stream_peaks(ch.samples(chunks, 7), "pos", "value", noise, 5, 1.0).withColumn("kind", F.lit("samples"))
    pieces = st.stream_peaks(chunks, "chunk", "values", noise, 5, 1.0).withColumn("kind", F.lit("chunks"))
    return rounded(single.unionByName(pieces))


@query("match_event_tables", MATCH_SQL)
def match_event_tables(spark, sf):
    """Maxima matched to minima by rounds of joins, as ``match_peaks`` matches their arrays."""
    s = sig(spark, sf)
    up = s.select("sample_id", F.explode(pu.find_peaks("values")).alias("p")).select("sample_id", "p.pos")
    down = s.select("sample_id", F.explode(pu.find_peaks(F.transform("values", lambda x: -x))).alias("p")).select("sample_id", "p.pos")
    pairs, _ = st.match_event_tables(up, down, 3)
    return rounded(st.match_summary(up, down, pairs))
