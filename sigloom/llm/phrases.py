"""Phrase collocations by counting quotient filters.

Only phrases of at least ``min_count`` occurrences are wanted, and a phrase is never more frequent
than its parts, so the lengths are counted one after the other. Frequent words get dense ids; the
texts are written once as ids with gaps. An n-gram whose first and last n - 1 words are frequent is
packed into one integer, the id of its first n - 1 words beside that of its last word. Tasks count
packed n-grams in quotient filters, one for each range of the permuted integers (a shard); a shard
merges its sorted filters and keeps what is frequent. The rank of a kept key is the id of its
n-gram. Sorted keys are mapped by the workers from files of bounded size, never held by the driver.

Scores and the dropping of covered phrases are joins of these tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm import quotient
from sigloom.llm.slices import Tally, byte_values, slice_hashes, take_slices
from sigloom.llm.store import map_shared, shared_path, stored, write_shared
from sigloom.llm.text import chunks, mix, utf8

_U = np.uint64
#: n-grams that a shard adds up, that a task holds before it sends filters, and keys of a file.
SHARD_GRAMS, FLUSH_GRAMS, FILE_KEYS = 1 << 21, 1 << 22, 1 << 20
#: Distinct words that a task holds before it sends their counts on.
FLUSH_WORDS = 1 << 18
INSIDE, BLANK, BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = byte_values(1_313)
UNKNOWN = "und"


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, whether it opens a piece, and the text it is of."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind == INSIDE
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kind == BREAK)[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    return starts, ends, opens, text


def _codes(batch: pa.RecordBatch):
    """Bytes in lower case, spans, whether words open a piece, and hashes of (lang, word)."""
    data, offsets = utf8(batch.column("text"))
    data = _LOWER[data]
    starts, ends, opens, text = piece_words(data, offsets)
    langs = batch.column("lang").dictionary_encode()
    names, places = utf8(langs.dictionary)
    salt = slice_hashes(names, places[:-1], places[1:], _VALUES)
    which = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    codes = mix(slice_hashes(data, starts, ends, _VALUES) + salt[which] * _U(0x2545F4914F6CDD1D)) if len(starts) else np.zeros(0, np.uint64)
    return data, starts, ends, opens, codes, text


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word, code, n of every distinct word of every language; ``texts`` has lang and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(FLUSH_WORDS)
        for whole in batches:
            for batch in chunks(whole):
                data, starts, ends, _, codes, text = _codes(batch)
                code, first, often = np.unique(codes, return_index=True, return_counts=True)
                lang = batch.column("lang").take(pa.array(text[first]))
                tally.add(code, often, lang, take_slices(data, starts[first], ends[first], pa.string()))
                if tally.full():
                    yield tally.batch("lang", "word")
        if tally.number:
            yield tally.batch("lang", "word")

    parts = texts.mapInArrow(work, "code long, lang string, word string, n long")
    return parts.groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Where the sorted keys of the frequent n-grams of one length are, and how they are packed."""

    folder: str
    length: int
    bits: int
    file_bits: int = 0
    #: rank of the first key of each file
    bases: list[int] = field(default_factory=list)
    size: int = 0

    def path(self, file: int) -> str:
        return f"{self.folder}/{self.length}-{file:06d}"


def store_level(kept: DataFrame, level: Level) -> DataFrame:
    """Write the sorted keys of ``kept`` (code: the bits of an unsigned key) into files and return
    its rows with their rank. Keys are spread evenly, so a file holds about ``FILE_KEYS``."""
    level.size = kept.count()
    level.file_bits = min(level.bits, max(0, math.ceil(math.log2(max(1, level.size) / FILE_KEYS))))
    shift = level.bits - level.file_bits

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["code"].to_numpy().view(np.uint64))]
        write_shared(level.path(int(pdf["file"].iloc[0])), pdf["code"].to_numpy().tobytes())
        return pdf.assign(at=np.arange(len(pdf)))

    file = F.shiftrightunsigned("code", shift) if shift < 64 else F.lit(0).cast("long")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    placed = kept.withColumn("file", file).groupBy("file").applyInPandas(work, f"{fields}, file long, at long")
    placed = stored(placed, "phrase-level")
    sizes = {r[0]: r[1] for r in placed.groupBy("file").count().collect()}  # one row per file
    level.bases = np.cumsum([0, *[sizes.get(i, 0) for i in range((1 << level.file_bits) - 1)]]).tolist()
    bases = kept.sparkSession.createDataFrame(list(enumerate(level.bases)), "file long, base long")
    return placed.join(F.broadcast(bases), "file").withColumn("rank", F.col("base") + F.col("at")).drop("file", "base", "at")


class Ranks:
    """Look-ups in the mapped keys of one level."""

    def __init__(self, level: Level):
        self.level, self.files = level, {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """1 + rank of every key, 0 of those that are not kept."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        shift = self.level.bits - self.level.file_bits
        file = (distinct >> _U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(distinct), np.int64)
        cuts = np.flatnonzero(np.diff(file, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(distinct)]):
            number = int(file[a])
            if number not in self.files:
                data = map_shared(self.level.path(number))
                self.files[number] = np.zeros(0, np.uint64) if data is None else data.view(np.uint64)
            here = self.files[number]
            if len(here):
                at = np.searchsorted(here, distinct[a:b])
                at[at == len(here)] = 0
                out[a:b] = np.where(here[at] == distinct[a:b], self.level.bases[number] + at + 1, 0)
        return out[back]


_ranks: dict[str, Ranks] = {}


def _finder(level: Level) -> Ranks:
    return _ranks.setdefault(level.path(0), Ranks(level))


def encode_words(texts: DataFrame, words: Level) -> DataFrame:
    """The texts as ids of frequent words from 1 on, 0 for other words and between pieces; one
    row per chunk of texts. A stored table."""
    wide = np.uint32 if words.size < (1 << 32) - 1 else np.uint64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(words)
        for whole in batches:
            for batch in chunks(whole):
                _, _, _, opens, codes, _ = _codes(batch)
                gaps = np.cumsum(opens)
                line = np.zeros(len(codes) + (int(gaps[-1]) if len(gaps) else 0), wide)
                line[np.arange(len(codes)) + gaps] = find(codes) if len(codes) else 0
                yield pa.RecordBatch.from_arrays([pa.array([line.tobytes()], pa.binary())], ["ids"])

    return stored(texts.mapInArrow(work, "ids binary"), "phrase-ids")


def packed_grams(ids: np.ndarray, levels: list[Level], word_bits: int) -> np.ndarray:
    """Packed n-grams, one word longer than those of the last of ``levels``, at every place where
    both parts of n - 1 words are frequent."""
    now = ids  # 1 + rank of the n-gram that starts here, or 0
    for length in range(2, len(levels) + 2):
        both = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0))
        keys = ((now[both] - 1).astype(np.uint64) << _U(word_bits)) | (ids[both + length - 1] - 1).astype(np.uint64)
        if length == len(levels) + 1:
            return keys
        level = levels[length - 1]
        now = np.zeros(max(0, len(now) - 1), np.int64)
        if len(both):
            now[both] = _finder(level)(quotient.permute(keys, level.bits))
    return np.zeros(0, np.uint64)


def count_grams(encoded: DataFrame, levels: list[Level], bits: int, word_bits: int, most: int, min_count: int) -> DataFrame:
    """code (permuted packed n-gram) and n of the frequent n-grams of the next length; ``most``: an
    upper bound of their occurrences. A stored table."""
    shard_bits = min(bits, max(0, math.ceil(math.log2(max(1, most) / SHARD_GRAMS))))
    rest = bits - shard_bits
    wide = np.uint32 if levels[0].size < (1 << 32) - 1 else np.uint64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def send() -> pa.RecordBatch:
            keys = np.sort(quotient.permute(np.concatenate(held), bits))
            keys, counts = quotient.add_up(keys, np.ones(len(keys), np.int64))
            shard = (keys >> _U(rest)).astype(np.int64) if rest < 64 else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            inner = keys & _U((1 << rest) - 1)
            blobs = [quotient.encode(inner[a:b], counts[a:b], rest) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(blobs, pa.binary())], ["shard", "filter"])

        for batch in batches:
            for blob in batch.column("ids"):
                keys = packed_grams(np.frombuffer(blob.as_buffer(), wide).astype(np.int64), levels, word_bits)
                if len(keys):
                    held.append(keys)
                    number += len(keys)
                if number >= FLUSH_GRAMS:
                    yield send()
                    held, number = [], 0
        if number:
            yield send()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = quotient.merge(list(pdf["filter"]))
        often = counts >= min_count
        shard = _U(int(pdf["shard"].iloc[0])) << _U(rest) if rest < 64 else _U(0)
        return pd.DataFrame({"code": (keys[often] | shard).view(np.int64), "n": counts[often]})

    filters = encoded.mapInArrow(count, "shard long, filter binary")
    return stored(filters.groupBy("shard").applyInPandas(add, "code long, n long"), "phrase-grams")


def _unpacked(grams: DataFrame, bits: int, word_bits: int) -> DataFrame:
    """rank, prefix (rank of the first words), last (id of the last word), f."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = quotient.restore(batch.column("code").to_numpy().view(np.uint64), bits)
            prefix, last = (key >> _U(word_bits)).astype(np.int64), (key & _U((1 << word_bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), pa.array(prefix), pa.array(last), batch.column("n")], ["rank", "prefix", "last", "f"]
            )

    return grams.select("code", "n", "rank").mapInArrow(work, "rank long, prefix long, last long, f long")


PHRASE = "rank long, lang string, phrase string, f long, heads array<long>, tails array<long>"
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def frequent_phrases(texts: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for lengths 1, 2, ..., the phrases of at least ``min_count`` occurrences:
    lang, phrase, f, heads (f of the first 1, 2, ... words), tails (f of what the same cuts leave).
    ``texts`` has lang and text."""
    folder = shared_path(texts.sparkSession, "phrases")
    words = stored(count_words(texts), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    level = Level(folder, 1, 64)
    nothing = F.array().cast("array<long>")
    ranked = store_level(words.where(F.col("n") >= min_count), level)
    tables = [ranked.select("rank", "lang", F.col("word").alias("phrase"), F.col("n").alias("f"), nothing.alias("heads"), nothing.alias("tails"))]
    levels, word_bits = [level], max(1, (level.size - 1).bit_length())
    if not level.size or max_words < 2:
        return totals, tables
    encoded = encode_words(texts, level)
    for length in range(2, max_words + 1):
        below = tables[-1]
        bits = max(1, (levels[-1].size - 1).bit_length()) + word_bits
        if bits > 64:
            raise ValueError("n-grams of so many frequent words do not fit 64 bits")
        most = below.agg(F.sum("f")).first()[0]
        grams = count_grams(encoded, levels, bits, word_bits, most, min_count)
        level = Level(folder, length, bits)
        rows = _unpacked(store_level(grams, level), bits, word_bits)
        if not level.size:
            break
        first = below.select(F.col("rank").alias("prefix"), "lang", F.col("phrase").alias("begin"), F.col("f").alias("begins"), "heads")
        last = tables[0].select(F.col("rank").alias("last"), F.col("phrase").alias("word"))
        rest = below.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_rest"), F.col("f").alias("_f"), F.col("tails").alias("_tails"))
        phrase = F.concat_ws(" ", "begin", "word")
        joined = rows.join(first, "prefix").join(last, "last").withColumn("phrase", phrase)
        after = F.expr("substring(phrase, locate(' ', phrase) + 1)")
        joined = joined.join(rest, (F.col("lang") == F.col("_lang")) & (after == F.col("_rest")))
        heads, tails = F.concat("heads", F.array("begins")), F.concat(F.array("_f"), "_tails")
        tables.append(stored(joined.select("rank", "lang", "phrase", "f", heads.alias("heads"), tails.alias("tails")), "phrases"))
        levels.append(level)
    return totals, tables


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language of ``docs`` (text,
    lang), by descending score, descending a, ascending phrase.

    A-Z count as a-z. Texts are split at ``.,;:!?`` and line ends into pieces and those at blanks
    and tabs into words; a phrase has 2 to ``max_words`` words of one piece and occurs a >=
    ``min_count`` times, overlaps included. n counts the words of the language. The score of a cut
    into l and r occurrences is floor(1000 a n / (l r)); the lowest cut counts, the first among
    equals. A phrase that a longer one of equally many occurrences contains is left out.

    A null text counts as empty, a null lang as ``und``. Rows that repeat count each; doc_id and
    other columns are not looked at. No phrase frequent enough: no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    totals, tables = frequent_phrases(texts, max_words, min_count)
    if len(tables) < 2:
        return spark.createDataFrame([], RESULT)
    kept = None
    for at, table in enumerate(tables[1:], 1):
        if at + 1 < len(tables):
            longer = tables[at + 1]
            cover = [F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")]
            covered = longer.select("lang", "f", F.explode(F.array(*cover)).alias("phrase")).distinct()
            table = table.join(covered, ["lang", "phrase", "f"], "left_anti")
        table = table.select("lang", "phrase", "f", "heads", "tails")
        kept = table if kept is None else kept.unionByName(table)
    wide = "CAST({} AS DECIMAL(19,0))"
    score = f"(1000 * {wide.format('f')} * {wide.format('n')}) div ({wide.format('heads[k]')} * {wide.format('tails[k]')})"
    cut = F.expr(f"array_min(transform(sequence(0, size(heads) - 1), k -> struct({score} AS score, k AS k, heads[k] AS l, tails[k] AS r)))")
    scored = kept.join(totals, "lang").withColumn("cut", cut)
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= most)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    )
