"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their votes are folded to counts
of vote patterns over the whole corpus; expectation-maximisation on the patterns estimates how often
each labeller is right on good and on bad documents, and so the posterior of every pattern. The
posteriors of a bounded sample train a linear scorer on hashed features, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import stored
from sigloom.llm.text import chunks, mix, seeds, utf8, word_hashes, word_spans

_U = np.uint64
NONE, BAD, GOOD = 0, 1, 2
#: Hashed features of the scorer.
BINS = 4096
#: Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in a is that it was for on with as by be this are from or an at not have he "
    "de la le les et des en un une du que qui dans pour par sur au est pas plus ce il "
    "der die das und den von zu mit sich dem ein eine nicht auf ist im des als auch es "
    "el los las y que un una con por para se su del lo al como más no o"
).split()
LABELLERS = ("symbols", "capitals", "repetition", "function_words", "word_length", "word_shape")

_ASCII = np.arange(256)
_LETTER = (_ASCII >= 0x80) | np.isin(_ASCII | 0x20, np.arange(ord("a"), ord("z") + 1)) & (_ASCII < 0x80)
_CAPITAL = (_ASCII >= ord("A")) & (_ASCII <= ord("Z"))
_DIGIT = (_ASCII >= ord("0")) & (_ASCII <= ord("9"))
_WHITE = np.isin(_ASCII, [0x20, *range(9, 14)])
_PLAIN = np.isin(_ASCII, [ord(c) for c in ".,;:'\"()-?"])
_SYMBOL = ~(_LETTER | _DIGIT | _WHITE | _PLAIN)
#: Shape of a byte: letters, capitals, digits and spaces are one class each, other bytes are their own.
_SHAPE = np.where(_CAPITAL, 1, np.where(_LETTER, 2, np.where(_DIGIT, 3, np.where(_WHITE, 4, _ASCII % 60 + 4)))).astype(np.uint64)
_stops = word_hashes(*utf8(pa.array(FUNCTION_WORDS)))[0]


@dataclass
class Statistics:
    """What labellers and features look at, one value for each text."""

    words: np.ndarray
    symbols: np.ndarray
    capitals: np.ndarray
    fresh: np.ndarray  # distinct share of the three-word shingles
    function: np.ndarray
    length: np.ndarray
    shaped: np.ndarray  # share of words that start and end as words do


def statistics(data: np.ndarray, offsets: np.ndarray) -> Statistics:
    def per_text(flags: np.ndarray) -> np.ndarray:
        running = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return np.diff(running[offsets])

    starts, ends, firsts = word_spans(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    words = np.diff(firsts)
    some = np.maximum(words, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        running = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return np.diff(running[firsts])

    letters = per_text(_LETTER[data])
    visible = np.maximum(per_text(~_WHITE[data]), 1)
    factors = seeds(3, 8)
    n = max(0, len(hashes) - 2)
    triples = mix(sum((hashes[i : i + n] * factors[i] for i in range(3)), np.zeros(n, np.uint64)))
    fresh = np.ones(len(words))
    for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        if b - a >= 3:
            fresh[i] = len(np.unique(triples[a : b - 2])) / (b - a - 2)
    # the last byte may be punctuation of a sentence, the first one a bracket or quote
    proper = np.zeros(0, bool) if not len(starts) else (_LETTER | _DIGIT | _PLAIN)[data[starts]] & (_LETTER | _DIGIT | _PLAIN)[data[ends - 1]]
    return Statistics(
        words=words,
        symbols=per_text(_SYMBOL[data]) / visible,
        capitals=per_text(_CAPITAL[data]) / np.maximum(letters, 1),
        fresh=fresh,
        function=per_word(np.isin(hashes, _stops)) / some,
        length=visible / some,
        shaped=per_word(proper) / some,
    )


def votes(s: Statistics) -> np.ndarray:
    """Votes of the labellers (texts x labellers): 0 none, 1 bad, 2 good."""

    def vote(bad, good, known=True):
        return np.where(known & (s.words > 0), np.where(bad, BAD, np.where(good, GOOD, NONE)), NONE)

    enough = s.words >= 30
    return np.stack(
        [
            vote(s.symbols > 0.05, s.symbols < 0.02),
            vote(s.capitals > 0.25, s.capitals < 0.1, s.words >= 5),
            vote(s.fresh < 0.5, s.fresh > 0.8, enough),
            vote(s.function < 0.03, s.function > 0.1, enough),
            vote((s.length > 8) | (s.length < 3), (s.length > 4) & (s.length < 7), enough),
            vote(s.shaped < 0.7, s.shaped > 0.95, s.words >= 5),
        ],
        axis=1,
    )


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """Prior of good, and right[labeller, class]: the rate of right votes on bad and on good texts."""

    prior: float
    right: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good; the prior where nobody votes."""
        v = _votes_of(np.asarray(patterns))
        odds = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for i in range(v.shape[1]):
            bad, good = self.right[i]
            odds += np.where(v[:, i] == GOOD, np.log(good / (1 - bad)), 0) + np.where(v[:, i] == BAD, np.log((1 - good) / bad), 0)
        return 1 / (1 + np.exp(-odds))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over pattern counts, started from the majority of the votes. A
    vote that is not given tells nothing. Rates stay away from 0 and 1 by one pseudo-count."""
    v = _votes_of(patterns)
    lead = (v == GOOD).sum(axis=1) - (v == BAD).sum(axis=1)
    good = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, 0.5))
    model = LabelModel(0.5, np.full((len(LABELLERS), 2), 0.8))
    for _ in range(steps):
        weight_good, weight_bad = counts * good, counts * (1 - good)
        prior = (weight_good.sum() + 1) / (counts.sum() + 2)
        right = np.array(
            [
                [
                    (weight_bad[v[:, i] == BAD].sum() + 1) / (weight_bad[v[:, i] != NONE].sum() + 2),
                    (weight_good[v[:, i] == GOOD].sum() + 1) / (weight_good[v[:, i] != NONE].sum() + 2),
                ]
                for i in range(len(LABELLERS))
            ]
        )
        moved = np.abs(right - model.right).max()
        model = LabelModel(float(np.clip(prior, 1e-6, 1 - 1e-6)), right)
        good = model.posterior(patterns)
        if moved < tolerance:
            break
    return model


def features(data: np.ndarray, offsets: np.ndarray, s: Statistics) -> np.ndarray:
    """Hashed features of every text: square roots of the shares of byte-shape trigrams, and the
    statistics in steps."""
    texts = len(offsets) - 1
    out = np.zeros((texts, BINS), np.float32)
    if len(data) >= 3:
        shape = _SHAPE[data]
        trigram = shape[:-2] * _U(4096) + shape[1:-1] * _U(64) + shape[2:]
        column = (mix(trigram + _U(99)) % _U(BINS)).astype(np.int64)
        text = np.repeat(np.arange(texts), np.diff(offsets))
        inside = text[:-2] == text[2:]
        cells = np.bincount(text[:-2][inside] * BINS + column[inside], minlength=texts * BINS).reshape(texts, BINS)
        out[:] = np.sqrt(cells / np.maximum(cells.sum(axis=1, keepdims=True), 1))
    steps = {
        1: s.symbols * 40, 2: s.capitals * 20, 3: s.fresh * 20, 4: s.function * 40, 5: s.length * 2, 6: s.shaped * 20,
    }
    for name, value in steps.items():
        token = np.clip(value, 0, 40).astype(np.uint64) + _U(1000 * name)
        out[np.arange(texts), (mix(token) % _U(BINS)).astype(np.int64)] += 0.5
    out[:, int(mix(np.array([7], np.uint64))[0] % _U(BINS))] += 1.0
    return out


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray


def train(docs: DataFrame, fit_docs: int = 20_000, rounds: int = 4, passes: int = 3) -> Scorer:
    """Label model over all rows of ``docs`` (doc_id, text), and scorer on about ``fit_docs`` of
    them, drawn by a hash of the id and the text. Texts without words have no vote and are not
    drawn. Each round starts every partition of the sample from the common weights, and averages
    the weights that they come to.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for whole in batches:
            for batch in chunks(whole):
                s = statistics(*utf8(batch.column("text")))
                total += np.bincount(pattern_of(votes(s))[s.words > 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])

    # At most 3 ** 6 rows, whatever the corpus.
    folded = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    counts = folded["n"].to_numpy()
    labels = fit_labels(folded["pattern"].to_numpy(), counts)
    scorer = Scorer(labels, np.zeros(BINS, np.float32))
    if not len(counts):
        return scorer
    rate = min(1.0, fit_docs / counts.sum())
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id", "text"), 11).cast("double") / float(1 << 53)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=1 << 20):
                data, offsets = utf8(batch.column("text"))
                s = statistics(data, offsets)
                x = features(data, offsets, s)[s.words > 0]
                y = labels.posterior(pattern_of(votes(s)))[s.words > 0]
                rows, columns = np.nonzero(x)
                cuts = np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(columns.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[rows, columns])),
                        pa.array(y),
                    ],
                    ["columns", "values", "label"],
                )

    drawn = docs.where(F.col("text").isNotNull() & (draw < rate)).select("text")
    sample = stored(drawn.mapInArrow(featurise, "columns array<int>, values array<float>, label double").repartition(8), "sample")
    for r in range(rounds):
        start = scorer.weights

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, speed, number = start.astype(np.float64), np.full(BINS, 1e-3), 0
            held = [b for b in batches]  # an eighth of the bounded sample
            for _ in range(passes):
                for batch in held:
                    columns, values, label = batch.column("columns"), batch.column("values"), batch.column("label").to_numpy()
                    for a in range(0, len(label), 32):
                        part = slice(a, a + 32)
                        where = [c.values.to_numpy() for c in columns[part]]
                        what = [c.values.to_numpy() for c in values[part]]
                        slope = np.zeros(BINS)
                        for c, x, y in zip(where, what, label[part]):
                            slope[c] += x * (1 / (1 + np.exp(-np.clip(w[c] @ x, -30, 30))) - y)
                        slope = slope / len(where) + 1e-5 * w
                        speed += slope**2
                        w -= 0.5 * slope / np.sqrt(speed)
                        number += len(where)
            if number:
                yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tolist()], pa.list_(pa.float32())), pa.array([number])], ["w", "n"])

        ends = sample.mapInArrow(descend, "w array<float>, n long").collect()  # BINS numbers for each partition
        if ends:
            scorer.weights = np.average([e["w"] for e in ends], axis=0, weights=[e["n"] for e in ends]).astype(np.float32)
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, posterior, score and kept for every row of ``docs`` (doc_id, text).

    posterior is the label model's probability of good, score the linear scorer's on the whole
    text, kept whether it reaches ``threshold``. A null text, or one without words, scores 0.
    Rows are independent of each other, so repeated ones agree; other columns are left.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BINS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in chunks(whole, limit=1 << 20):
                data, offsets = utf8(batch.column("text"))
                s = statistics(data, offsets)
                p = 1 / (1 + np.exp(-np.clip(features(data, offsets, s) @ model.weights, -30, 30)))
                p = np.where(s.words > 0, p.astype(np.float64), 0.0)
                posterior = model.labels.posterior(pattern_of(votes(s)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(posterior), pa.array(p), pa.array((p >= threshold) & (s.words > 0))],
                    ["doc_id", "posterior", "score", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, posterior double, score double, kept boolean")
