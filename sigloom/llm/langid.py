"""Language identification with language-bitmask n-gram filters.

The byte n-grams that are usual in each language are put into one Bloom filter per language.
The filters are bit-sliced: word i of the table holds bit i of all of them, so the AND of the
words at an n-gram's positions is the mask of all languages that contain it. A text is decided
by how many of its n-grams each language contains, less the false positives that are to be
expected from how full its filter is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.text import chunks, mix, utf8

UNKNOWN = "und"
_U = np.uint64
_SEED = _U(0xD6E8FEB86659FD93)
#: Bytes that belong to words: ASCII letters and every byte of a multi-byte character.
_FOLD = np.full(256, 0x20, np.uint8)
for _c in range(26):
    _FOLD[ord("a") + _c] = _FOLD[ord("A") + _c] = ord("a") + _c
_FOLD[0x80:] = np.arange(0x80, 0x100)


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the byte n-grams of all texts, and the index of each text's first one.

    A-Z is folded, everything that is no letter becomes one space, and every text stands between
    spaces, so word starts and ends are n-grams too. n-grams lie within one word and the spaces
    around it; a word that is shorter than that is one key with its two spaces.
    """
    folded = _FOLD[data]
    framed = np.full(len(data) + len(offsets), 0x20, np.uint8)  # one space before each text and at the end
    texts = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    framed[np.arange(len(data)) + texts] = folded
    space = framed == 0x20
    keep = np.ones(len(framed), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets + np.arange(len(offsets))] = True  # the frames stay, so that texts stay apart
    kept = np.flatnonzero(keep)
    m = len(kept)
    line = np.full(m + n, 0x20, np.uint64)
    line[:m] = framed[kept]
    first = np.searchsorted(kept, offsets + np.arange(len(offsets)))
    keys = line[:m].copy()
    for i in range(1, n):
        keys |= line[i : i + m] << _U(8 * i)
    blank = line == 0x20
    use = np.ones(m, bool)
    for i in range(1, n - 1):
        use &= ~blank[i : i + m]
    gaps = np.flatnonzero(blank[:m])
    lengths = np.diff(gaps) - 1
    for length in range(1, n - 2):  # such a word starts no n-gram of its own
        at = gaps[:-1][lengths == length]
        keys[at] = line[at]
        for i in range(1, length + 2):
            keys[at] |= line[at + i] << _U(8 * i)
        use[at] = True
    use[first[-1]] = False  # the closing frame
    counted = np.concatenate([[0], np.cumsum(use)])
    return keys[use], counted[first]


def positions(keys: np.ndarray, bits: int, hashes: int) -> list[np.ndarray]:
    """Positions of every key in the filter of 2**bits places."""
    mixed = mix(keys * _SEED + _SEED)
    low, step = mixed, (mixed >> _U(32)) | _U(1)
    mask = _U((1 << bits) - 1)
    return [((low + _U(i) * step) & mask).astype(np.int64) for i in range(hashes)]


@dataclass
class Filters:
    """The bit-sliced filters of all languages, at most 64 to a word."""

    languages: list[str]
    table: np.ndarray  # one word for each place
    default: str  # the most frequent language, for texts without any known n-gram
    n: int
    hashes: int

    def false_positives(self) -> np.ndarray:
        """Rate of each language: how full its filter is, to the power of the hash count."""
        planes = [((self.table >> self.table.dtype.type(i)) & self.table.dtype.type(1)).mean() for i in range(len(self.languages))]
        return np.array(planes) ** self.hashes

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected number of n-grams in each language (texts x languages), and of all."""
        keys, first = ngrams(data, offsets, self.n)
        bits = int(math.log2(len(self.table)))
        masks = None
        for at in positions(keys, bits, self.hashes):
            masks = self.table[at] if masks is None else masks & self.table[at]
        total = np.diff(first)
        hits = np.zeros((len(total), len(self.languages)))
        if masks is not None and len(masks):
            for i in range(len(self.languages)):
                one = (masks >> masks.dtype.type(i)) & masks.dtype.type(1)
                running = np.concatenate([[0], np.cumsum(one, dtype=np.int64)])
                hits[:, i] = np.diff(running[first])
        wrong = self.false_positives()
        return np.clip((hits - total[:, None] * wrong) / np.maximum(1e-9, 1 - wrong), 0, None), total


def train(
    docs: DataFrame, n: int = 5, fit_docs: int = 4000, bits: int = 20, hashes: int = 3, rarest: float = 2e-3,
    least: float = 0.1,
) -> Filters:
    """Filters from text and lang of ``docs``; rows without either are left out.

    About ``fit_docs`` documents of each language are used, drawn by a hash of the text; a
    language with fewer uses all. An n-gram belongs to a language if at least ``rarest`` of its
    drawn documents contain it, and ``least`` as large a part of them as of any other language's,
    which keeps quoted foreign words out. An n-gram of a single text counts only where that is the
    language's only drawn text. Equal texts are drawn alike and count once. Without any row
    there are no languages, and every text is unknown. More than 64 languages raise.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    languages = sorted(sizes)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    if not languages:
        return Filters([], np.zeros(1 << bits, kind), UNKNOWN, n, hashes)
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_docs / sizes[k]))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("lang"), "text"), 11).cast("double") / float(1 << 53)
    code = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    drawn = known.where(draw < rate[F.col("lang")]).select(code[F.col("lang")].cast("int").alias("lang"), "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                keys, first = ngrams(*utf8(batch.column("text")), n)
                lang = batch.column("lang").to_numpy().astype(np.int64)
                spans = [np.unique(keys[a:b]) for a, b in zip(first[:-1], first[1:])]
                for code in np.unique(lang):
                    mine = [s for s, c in zip(spans, lang) if c == code]
                    gram, times = np.unique(np.concatenate(mine), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), code, np.int32)), pa.array(times, pa.int64())],
                        ["gram", "lang", "n"],
                    )

    grams = drawn.mapInArrow(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    used = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.create_map(*[F.lit(x) for i in range(len(languages)) for x in (i, 1.0 / max(1, used.get(i, 0)))])
    alone = F.create_map(*[F.lit(x) for i in range(len(languages)) for x in (i, used.get(i, 0) == 1)])
    rates = grams.where((F.col("n") > 1) | alone[F.col("lang")]).select("gram", "lang", (F.col("n") * part[F.col("lang")]).alias("rate"))
    each = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("rates"))  # at most 64
    usual = F.filter("rates", lambda r: (r["rate"] >= rarest) & (r["rate"] >= F.col("top") * least))
    one = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r["lang"])
    mask = F.aggregate(usual, F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(one(r)))
    masks = each.select("gram", mask.alias("mask")).where("mask <> 0")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(batch.column("gram").to_numpy().view(np.uint64), bits, hashes)
            mask = np.tile(batch.column("mask").to_numpy(), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(mask)], ["place", "mask"])

    # At most 2**bits rows whatever the corpus: the filter itself.
    filled = masks.mapInArrow(place, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(1 << bits, np.uint64)
    table[filled["place"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    default = max(languages, key=lambda k: (sizes[k], k))
    return Filters(languages, table.astype(kind), default, n, hashes)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Columns of ``docs`` with lang_pred, score and coverage, from the whole ``text``.

    lang_pred is ``und`` with score 0 if the text is null or has no letter; else the language
    with the largest corrected count, ties to the first by name; the most frequent language with
    score 0 if no n-gram is known. score is that language's part of all corrected counts shared
    out by squares, coverage its part of the n-grams. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # 2**bits words
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "coverage")]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    flagged = docs.select(*names, letter.alias("_letter"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        labels = np.array([*f.languages, f.default, UNKNOWN], object)
        for whole in batches:
            for batch in chunks(whole):
                hits, total = f.counts(*utf8(batch.column("text")))
                letters = batch.column("_letter").to_numpy(zero_copy_only=False)
                if not f.languages:
                    letters = np.zeros(len(letters), bool)
                    hits = np.zeros((len(letters), 1))
                best = hits.argmax(axis=1)
                top = hits.max(axis=1)
                squares = (hits**2).sum(axis=1)
                score = np.where(letters & (top > 0), top**2 / np.maximum(squares, 1e-300), 0.0)
                coverage = np.where(letters, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
                best[top <= 0] = len(f.languages)
                best[~letters] = len(f.languages) + 1
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(labels[best], pa.string()), pa.array(score), pa.array(coverage)],
                    [*names, "lang_pred", "score", "coverage"],
                )

    schema = flagged.select(*names).schema.add("lang_pred", "string").add("score", "double").add("coverage", "double")
    return flagged.mapInArrow(work, schema)
