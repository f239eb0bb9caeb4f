"""Token counts without token ids: every distinct pre-token is cut into pieces once.

One pass over the texts counts pre-tokens, pre-aggregated in the tasks; the pieces of every distinct
pre-token are counted once, in a table. A second pass makes the pre-token frequencies of every
document and joins them with that table: the at most ``head`` most frequent pre-tokens travel to the
tasks as two sorted arrays, the others are joined by a shuffle. A pre-token outside the head is
rarer than all tokens / ``head``, so no key of the shuffled join is hot.

Pre-tokens are found without a regular expression, by the class automaton of byte-level BPE.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.bpe import boundaries
from sigloom.llm.slices import Tally, byte_values, slice_hashes, take_slices
from sigloom.llm.store import stored
from sigloom.llm.text import chunks, utf8

#: Pre-tokens whose piece counts are sent to every task: 12 bytes each.
HEAD = 1 << 20
#: Distinct pre-tokens that a task holds before it sends their counts on.
FLUSH = 1 << 18
_VALUES = byte_values(1_111)


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself if it is visible
    Latin-1, else the next unused code point from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


LETTERS = _byte_letters()


class PieceCounter:
    """What a tokenizer file says about texts: special strings, and the pieces of a pre-token."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        said = json.loads(definition)
        split = said["pre_tokenizer"] or {}
        if said["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level files without normalizer and prefix space are supported")
        added = said["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take their surroundings are not supported")
        names = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(names)) if names else None
        self.model = Tokenizer.from_str(definition).model

    def pieces(self, token: bytes) -> int:
        return len(self.model.tokenize(token.decode("latin-1").translate(LETTERS)))

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts between special strings, the text that each is of, and the number of special
        strings in each text."""
        owner, number = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        if self.special is None:
            return texts, owner, number
        hit = pc.fill_null(pc.match_substring_regex(texts, self.special.pattern), False).to_numpy(zero_copy_only=False)
        if not hit.any():
            return texts, owner, number
        parts = [self.special.split(t) if h else [t] for t, h in zip(texts.to_pylist(), hit)]
        sizes = np.array([len(p) for p in parts])
        return pa.array([x for p in parts for x in p], pa.string()), np.repeat(owner, sizes), sizes - 1


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end byte of every pre-token, and the text that it is of."""
    data, offsets = utf8(texts)
    if not len(data):
        return data, *[np.zeros(0, np.int64)] * 3
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        starts = boundaries(data.astype(np.uint32), offsets[1:])
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = lead[boundaries(points, np.searchsorted(lead, offsets[1:]))]
    ends = np.append(starts[1:], len(data))
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_counters: dict[int, PieceCounter] = {}


def _counter(definition: str) -> PieceCounter:
    key = hash(definition)
    if key not in _counters:
        _counters[key] = PieceCounter(definition)
    return _counters[key]


def read_definition(path: str) -> str:
    """The text of a tokenizer file; a vocabulary has a fixed size of some ten thousand tokens."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def piece_table(texts: DataFrame, definition: str) -> DataFrame:
    """code, token, n, pieces: every distinct pre-token of ``texts`` (text), its hash, its number of
    occurrences and of pieces. A stored table."""
    said = texts.sparkSession.sparkContext.broadcast(definition)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, tally = _counter(said.value), Tally(FLUSH)
        for whole in batches:
            for batch in chunks(whole):
                segments, _, _ = counter.segments(batch.column("text"))
                data, starts, ends, _ = pre_tokens(segments)
                code, first, often = np.unique(slice_hashes(data, starts, ends, _VALUES), return_index=True, return_counts=True)
                tally.add(code, often, take_slices(data, starts[first], ends[first], pa.binary()))
                if tally.full():
                    yield tally.batch("token")
        if tally.number:
            yield tally.batch("token")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(said.value)
        for batch in batches:
            pieces = [counter.pieces(t) for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["code", "token", "n", "pieces"])

    counted = texts.select("text").mapInArrow(count, "code long, token binary, n long")
    counted = counted.groupBy("code", "token").agg(F.sum("n").alias("n"))
    return stored(counted.mapInArrow(cut, "code long, token binary, n long, pieces long"), "pieces")


def head_threshold(table: DataFrame, head: int) -> int:
    """The least count for which at most ``head`` rows of the table have that count or more, within
    one cell of a scale that is exact up to 1,024 and has eight cells for each doubling beyond."""
    step = F.floor(F.log2("n") * 8) / 8
    cell = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.ceil(F.pow(F.lit(2.0), step)))
    rows = table.groupBy(cell.cast("long").alias("least")).agg(F.count(F.lit(1)).alias("rows")).collect()
    cut, total = None, 0
    for least, number in sorted(((r["least"], r["rows"]) for r in rows), reverse=True):
        total += number
        if total > head:
            break
        cut = least
    return 1 << 62 if cut is None else cut


def token_counts(docs: DataFrame, definition: str, limit: int = 512, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for every row of ``docs``
    (doc_id, text), as the tokenizer of ``definition`` (``read_definition``) counts them.

    Special strings inside a text are one token each and split it; nothing is added, truncated or
    padded. A null or empty text has 0 bytes and 0 tokens. Rows that repeat, or that have no doc_id,
    are counted each; other columns are not looked at. An empty table gives an empty one.

    Hashes of 64 bits stand for pre-tokens inside a task and in the head; the shuffled join compares
    the pre-tokens themselves.
    """
    spark = docs.sparkSession
    table = piece_table(docs, definition)
    cut = head_threshold(table, head)
    known = table.where(F.col("n") >= cut).select("code", "pieces").toArrow()  # at most ``head`` rows
    codes, sizes = (known.column(i).to_numpy() for i in range(2))
    codes = codes.view(np.uint64)
    order = np.argsort(codes)
    said = spark.sparkContext.broadcast((definition, codes[order], sizes[order].astype(np.int32)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, head_codes, head_sizes = said.value
        counter = _counter(text)
        for whole in batches:
            for batch in chunks(whole):
                rows = batch.num_rows
                segments, owner, special = counter.segments(batch.column("text"))
                data, starts, ends, of = pre_tokens(segments)
                code, first, which = np.unique(slice_hashes(data, starts, ends, _VALUES), return_index=True, return_inverse=True)
                pair, often = np.unique(owner[of] * max(1, len(code)) + which, return_counts=True)
                doc, which = pair // max(1, len(code)), pair % max(1, len(code))
                at = np.searchsorted(head_codes, code)
                at[at == len(head_codes)] = 0
                hit = head_codes[at] == code if len(head_codes) else np.zeros(len(code), bool)
                pieces = np.where(hit, head_sizes[at] if len(head_codes) else 0, 0)
                total = special + np.bincount(doc, often * pieces[which], rows).astype(np.int64)
                rare = ~hit[which]
                offsets = np.searchsorted(doc[rare], np.arange(rows + 1)).astype(np.int32)
                where = first[which[rare]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(offsets), take_slices(data, starts[where], ends[where], pa.binary())),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(often[rare].astype(np.int64))),
                    ],
                    ["doc_id", "n_bytes", "n_head", "rare", "often"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_head long, rare array<binary>, often array<long>"
    rows = docs.select("doc_id", "text").mapInArrow(frequencies, schema).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "frequencies")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("token"), "x.often")
    others = table.where(F.col("n") < cut).select("token", "pieces")
    sums = rare.join(others, "token").groupBy("row").agg(F.sum(F.col("often") * F.col("pieces")).alias("n_rare"))
    n_tokens = (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_tokens")
    return (
        rows.select("doc_id", "n_bytes", "n_head", "row")
        .join(sums, "row", "left")
        .select("doc_id", "n_bytes", n_tokens)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
