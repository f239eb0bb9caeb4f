"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by their number. For every sample and term, hashes
of the term give two gamma(2, 1) variates and a uniform one; they turn the weight into a sampled
level and an arrival value, and the term that arrives first, with its level, is the sample. Two
texts agree on a sample with a probability that equals their generalised Jaccard similarity,
sum(min of weights) / sum(max of weights).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.text import chunks, mix, seeds, word_hashes
from sigloom.session import parallelism

SAMPLES = 96
_U = np.uint64
#: (term, weight) pairs that are drawn at once.
BLOCK = 8192
#: Of these, so many at a time, which stay in the processor's cache.
STEP = 128


def _uniforms(terms: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent uniform variates in (0, 1) for each term (rows) and sample (columns)."""
    bits = mix(terms[:, None] ^ lane[None, :])
    scale, half = np.float32(2.0**-24), np.float32(2.0**-25)
    high = (bits >> _U(40)).astype(np.float32) * scale + half
    return high, (bits & _U(0xFFFFFF)).astype(np.float32) * scale + half


class Sampler:
    """Packed samples of (term, weight): arrival value above, identity of term and level below."""

    def __init__(self, samples: int = SAMPLES, seed: int = 11):
        self.samples = samples
        self.lanes = [seeds(samples, seed + i) for i in range(3)]

    def draw(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One row for each (term, weight): the float32 arrival bits << 32 | 32-bit identity."""
        u, v = _uniforms(terms, self.lanes[0])
        r = -np.log(u * v)
        u, v = _uniforms(terms, self.lanes[1])
        c = -np.log(u * v)
        shift, _ = _uniforms(terms, self.lanes[2])
        level = np.floor(np.log(weights.astype(np.float32))[:, None] / r + shift)
        arrival = c * np.exp(-r * (level - shift + np.float32(1)))
        who = (terms[:, None] >> _U(32)) ^ (level.astype(np.int64).view(np.uint64) * _U(0x9E3779B1) & _U(0xFFFFFFFF))
        return (arrival.view(np.uint32).astype(np.uint64) << _U(32)) | who

    def fingerprints(self, terms: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """One row of 16-bit samples for each text; zeros for a text without words.

        ``terms``: word hashes of all texts; ``firsts``: index of each text's first word. Each
        distinct (term, weight) is drawn once for all texts, in blocks of bounded size.
        """
        texts = len(firsts) - 1
        out = np.zeros((texts, self.samples), np.uint16)
        if not len(terms):
            return out
        vocabulary, code = np.unique(terms, return_inverse=True)
        text = np.repeat(np.arange(texts), np.diff(firsts))
        pairs, weights = np.unique(text * len(vocabulary) + code, return_counts=True)
        text, code = np.divmod(pairs, len(vocabulary))
        combos, row = np.unique(code * (weights.max() + 1) + weights, return_inverse=True)
        which, weight = np.divmod(combos, weights.max() + 1)
        best = np.full((texts, self.samples), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(combos), BLOCK):
            part = slice(start, start + BLOCK)
            steps = range(0, len(which[part]), STEP)
            drawn = np.concatenate([self.draw(vocabulary[which[part][a : a + STEP]], weight[part][a : a + STEP]) for a in steps])
            here = np.flatnonzero((row >= start) & (row < start + BLOCK))
            rows, owner = row[here] - start, text[here]
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            for i, a, b in zip(owner[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(owner)]):
                np.minimum(best[i], drawn[rows[a:b]].min(axis=0), out=best[i])
        some = np.diff(firsts) > 0
        out[some] = (mix(best[some] & _U(0xFFFFFFFF)) >> _U(48)).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of fingerprints, row by row: the rate of equal
    samples, less the 1 in 2**16 that agree by chance."""
    rate = (a == b).mean(axis=1)
    return np.clip((rate - 2.0**-16) / (1 - 2.0**-16), 0.0, 1.0)


_samplers: dict[tuple[int, int], Sampler] = {}


def _sampler(samples: int, seed: int) -> Sampler:
    return _samplers.setdefault((samples, seed), Sampler(samples, seed))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = 11) -> DataFrame:
    """doc_id and fingerprint (4 hex digits a sample) of every row of ``docs`` (doc_id, text).

    A null text counts as empty; a text without words has a fingerprint of zeros, which is like
    that of other such texts only. Equal texts have equal fingerprints.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(samples, seed)
        for whole in batches:
            for batch in chunks(whole, limit=3 << 20):
                prints = s.fingerprints(*_words([t or "" for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _hex(prints)], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fingerprint string")


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([p.astype(">u2").tobytes().hex() for p in prints], pa.string())


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, seed: int = 11) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Documents are ordered by descending doc_id, null last, equal ids by descending text; the one
    after the last is the first. The edited text replaces the last floor(n/2) code points by the
    first as many (or all) of the next document's text. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty. A
    table of one row is its own next.

    The texts are moved once, into slices of consecutive ids whose limits are quantiles of the
    ids; the first document of every slice is also sent to the slice before it. Tasks stream
    through their slices with one document of look-ahead.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slices = 2 * max(2, parallelism(spark))
    probs = F.lit([i / slices for i in range(1, slices)])
    limits = docs.select(F.percentile_approx("doc_id", probs, F.lit(max(10_000, 20 * slices))).alias("q")).first()["q"]
    limits = np.array(sorted(set(limits or [])), np.int64)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def slice_of(ids: pa.Array) -> np.ndarray:
        """0 for the largest ids; a null id lies in the last slice."""
        above = np.searchsorted(limits, ids.fill_null(0).cast(pa.int64()).to_numpy(), side="right")
        return len(limits) - np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, above)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(slice_of(ids), pa.int64())], ["doc_id", "slice"])

    # The first document of a slice follows the last one of the slice before (of the last slice,
    # for the first of all); empty slices are passed over. One number a slice passes the driver.
    placed = docs.select("doc_id").mapInArrow(narrow, f"doc_id {kind}, slice long")
    tops = {r["slice"]: r["top"] for r in placed.groupBy("slice").agg(F.max("doc_id").alias("top")).collect()}
    if not tops:
        return spark.createDataFrame([], _schema(docs))
    used = sorted(tops)
    before = {k: used[i - 1] for i, k in enumerate(used)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "slice", "extra"]
        for batch in batches:
            ids = batch.column("doc_id")
            at = slice_of(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text"), pa.array(at, pa.int64()), pa.array(np.zeros(len(at), np.int32))], names
            )
            first = [i for i, (k, v) in enumerate(zip(at.tolist(), ids.to_pylist())) if tops[k] == v]
            if first:
                to = pa.array([before[k] for k in at[first].tolist()], pa.int64())
                part = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), to, pa.array(np.ones(len(first), np.int32))], names
                )

    dealt = (
        rows.mapInArrow(deal, f"doc_id {kind}, text string, slice long, extra int")
        .repartitionByRange(len(used), "slice")
        .sortWithinPartitions("slice", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _sampler(samples, seed)
        held: list[tuple] = []  # (slice, doc_id, text, extra) whose next document is not known yet
        for whole in batches:
            for batch in chunks(whole, limit=3 << 20):
                held += zip(*[batch.column(c).to_pylist() for c in ("slice", "doc_id", "text", "extra")])
                pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[3] and a[0] == b[0]]
                held = held[-1:]
                if pairs:
                    yield _compare(s, pairs, whole.schema.field("doc_id").type)

    return dealt.mapInArrow(work, _schema(docs))


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )


def _compare(s: Sampler, pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    texts = [a[2] for a, _ in pairs]
    nexts = [b[2] for _, b in pairs]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts)]
    chain = [i for i in range(1, len(texts)) if nexts[i - 1] is texts[i] or nexts[i - 1] == texts[i]]
    linked = set(chain)
    alone = [i for i in range(len(texts)) if i + 1 not in linked]  # whose next is no row of this batch
    n, m = len(texts), len(alone)
    drawn = s.fingerprints(*_words(texts + edited + [nexts[i] for i in alone]))
    prints, changed = drawn[:n], drawn[n : 2 * n]
    following = np.empty_like(prints)
    following[:-1] = prints[1:]
    following[alone] = drawn[2 * n : 2 * n + m]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[1] for a, _ in pairs], kind),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            _hex(prints),
            _hex(changed),
            pa.array(likeness(prints, changed)),
            pa.array(likeness(prints, following)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
