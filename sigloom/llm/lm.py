"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Words are 48-bit hashes. Tasks count the n-grams of their documents and send them, sorted and
compressed, to shards; a shard adds them up, writes its n-grams as a sorted hash array with counts
into the shared folder, and passes on what the next lower order and the contexts need. Workers
map these files and look n-grams up by binary search; the driver keeps only a few totals.

A shard holds the n-grams of the contexts in its hash range, and what each of these contexts sums up to.
The n-grams of contexts that consist of very frequent words only are spread over all shards by their own
hash, so a frequent word does not make one shard large; only the sums of these few contexts travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import drop, map_shared, shared_path, stored, write_shared
from sigloom.llm.text import chunks, mix, seeds, utf8, word_hashes

_U = np.uint64
START, END = _U(1), _U(2)
#: Bytes of text for each shard, and tokens that a task counts before it sends them on.
SHARD_BYTES, FLUSH = 8 << 20, 1_200_000
#: Least number of buckets of an array file, and keys from which on it has 256 times as many.
BUCKETS, MANY = 256, 1 << 18
#: Array files that a worker keeps mapped; a process may have some 65,000 maps.
MAPS = 16_384
_FACTORS = seeds(16, 41)


def tokens(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends of all texts as 48-bit hashes, padded in front by order - 1 starts; the
    positions of real tokens; and the index of each text's first token among them."""
    hashes, firsts = word_hashes(*utf8(batch.column("text")))
    texts = len(firsts) - 1
    line = np.full(len(hashes) + texts * order, START, np.uint64)
    text = np.repeat(np.arange(texts), np.diff(firsts))
    at = np.arange(len(hashes)) + text * order + order - 1
    line[at] = np.maximum(hashes >> _U(16), _U(3))
    ends = firsts[1:] + order * np.arange(1, texts + 1) - 1
    line[ends] = END
    real = np.sort(np.concatenate([at, ends]))
    return line, real, firsts + np.arange(texts + 1)


def grams(line: np.ndarray, real: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each real token, one row each."""
    return np.stack([line[real - order + 1 + i] for i in range(order)], axis=1)


def fold(words: np.ndarray) -> np.ndarray:
    """48-bit hash of each row of words."""
    total = np.full(len(words), words.shape[1], np.uint64)
    for i in range(words.shape[1]):
        total = mix(total + words[:, i] * _FACTORS[i])
    return total >> _U(16)


def shard_of(words: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """Shard of each n-gram: by its context, or by itself if the context may be frequent."""
    if words.shape[1] == 1:
        return code_shard(fold(words), shards)
    place = fold(words[:, :-1])
    spread = frequent(words[:, :-1], hot)
    place[spread] = fold(words[spread])
    return code_shard(place, shards)


def frequent(contexts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Contexts of frequent words only: no other can be frequent."""
    out = np.full(len(contexts), len(hot) > 0)
    for i in range(contexts.shape[1] if len(hot) else 0):
        rows = np.flatnonzero(out)
        words = contexts[rows, i]
        out[rows] = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words
    return out


def code_shard(code: np.ndarray, shards: int) -> np.ndarray:
    return (code % _U(shards)).astype(np.int64)


def add_up(known: np.ndarray, code: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct rows of ``code``, indices into the sorted words ``known``, with the sums of their counts."""
    width, bits = code.shape[1], max(1, int(len(known) - 1).bit_length())
    if not len(code):
        return code, *counts
    if width * bits < 64:
        key = np.zeros(len(code), np.uint64)
        for i in range(width):
            key = (key << _U(bits)) | code[:, i].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort(code.T[::-1])
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code[order], axis=0) != 0).any(axis=1)]))
    return code[order[first]], *[np.add.reduceat(c[order].astype(np.int64), first) for c in counts]


def _planes(values: np.ndarray, size: int) -> bytes:
    """Lowest bytes of all values first, then the next ones: planes of zeros cost nothing when compressed."""
    return np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8).reshape(-1, size).T.tobytes()


def _from_planes(data: bytes, rows: int, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, rows).T).view(f"<u{size}").ravel().astype(np.int64)


def pack_rows(known: np.ndarray, code: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted rows with counts: the words that occur once each, and their places in that list."""
    if code.size * 8 < len(known):
        used, small = np.unique(code, return_inverse=True)
        small = small.reshape(code.shape)
    else:
        there = np.bincount(code.ravel(), minlength=len(known)) > 0
        used, small = np.flatnonzero(there), (np.cumsum(there) - 1)[code]
    columns = [np.diff(small[:, 0], prepend=0), *small.T[1:]]
    parts = [_planes(np.diff(known[used], prepend=_U(0)), 8), *[_planes(c, 4) for c in columns], *[_planes(c, 8) for c in counts]]
    head = np.array([len(code), code.shape[1], len(counts), *[len(p) for p in parts]], np.int64)
    stream = zstandard.ZstdCompressor(level=3).compressobj(size=head.nbytes + sum(map(len, parts)))
    out = [stream.compress(head.tobytes())]
    for part, n in zip(parts, [8, *[4] * len(columns), *[8] * len(counts)]):  # a block for each plane: random bytes and skewed ones are not coded alike
        for a in range(0, len(part), max(1, len(part) // n)):
            out += [stream.compress(part[a : a + len(part) // n]), stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
    return b"".join([*out, stream.flush()])


def unpack_rows(blob: bytes) -> tuple[np.ndarray, ...]:
    """Words, rows of places in them, and counts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    rows, width, kinds = np.frombuffer(raw, np.int64, 3).tolist()
    sizes = np.frombuffer(raw, np.int64, 1 + width + kinds, 24).tolist()
    parts, at = [], 24 + 8 * len(sizes)
    for size in sizes:
        parts.append(raw[at : at + size])
        at += size
    code = np.stack([_from_planes(p, rows, 4).astype(np.uint32) for p in parts[1 : 1 + width]], axis=1)
    code[:, 0] = np.cumsum(code[:, 0], dtype=np.uint32)
    known = np.cumsum(_from_planes(parts[0], len(parts[0]) // 8, 8)).astype(np.uint64)
    return known, code, *[_from_planes(p, rows, 8) for p in parts[1 + width :]]


def merged_rows(blobs) -> tuple[np.ndarray, ...]:
    """Words of all blobs, and their distinct rows with the sums of their counts."""
    parts = [unpack_rows(b) for b in blobs]
    known = np.unique(np.concatenate([p[0] for p in parts]))
    code = np.concatenate([np.searchsorted(known, words).astype(np.uint32)[rows] for words, rows, *_ in parts])
    counts = [np.concatenate(c) for c in zip(*[p[2:] for p in parts])]
    del parts
    return known, *add_up(known, code, *counts)


def _by_shard(known: np.ndarray, code: np.ndarray, counts: tuple[np.ndarray, ...], shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(shard, kind="stable")
    cuts = [*np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist(), len(order)] if len(order) else []
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        yield int(shard[rows[0]]), pack_rows(known, code[rows], *[c[rows] for c in counts])


def _array_file(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


def _arrays(data: np.ndarray, kinds: tuple) -> list[np.ndarray]:
    sizes = data[8 : 8 + 8 * len(kinds)].view(np.int64)
    out, at = [], 8 + 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        length = size * np.dtype(kind).itemsize
        out.append(data[at : at + length].view(kind))
        at += length + -length % 8
    return out


def _keyed(code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the 40-bit keys of 48-bit codes, and an index of them: where the buckets begin and what
    of a key the bucket does not tell, in planes of bytes. Many keys have 2**16 buckets, counted from
    every 256th on, and 24 bits left; few keys have 256 buckets and 32 bits left."""
    key = gram_key(code)
    order = np.argsort(key)
    key = key[order]
    steps = np.searchsorted(key >> _U(32), np.arange(BUCKETS + 1)).astype(np.int64)
    rest = (key & _U(0xFFFFFFFF)).astype(np.uint32)
    within, top = np.zeros(0, np.uint16), (rest >> 24).astype(np.uint8)
    if len(key) >= MANY and np.diff(steps).max() < 1 << 16:
        begins = np.searchsorted(key >> _U(24), np.arange(BUCKETS * 256 + 1))
        within, top = (begins - np.repeat(steps, 256)[: len(begins)]).astype(np.uint16), np.zeros(0, np.uint8)
    return order, [steps, within, (rest & 0xFFFF).astype(np.uint16), (rest >> 16 & 0xFF).astype(np.uint8), top]


def gram_file(code: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys of n-grams; two counts in a byte, those of 15 and more apart."""
    order, index = _keyed(code)
    counts = counts[order]
    large = np.flatnonzero(counts >= 15)
    small = np.append(np.minimum(counts, 15).astype(np.uint8), np.zeros(len(counts) % 2, np.uint8))
    return _array_file(*index, small[::2] | small[1::2] << 4, large.astype(np.uint32), counts[large].astype(np.int64))


def _kinds(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The few different rows of some columns of counts, and which of them each row is: a byte for the
    most frequent ones, 255 for the others, whose places and numbers stand apart."""
    which = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, code = np.unique(c, return_inverse=True)
        which = np.unique(which * len(values) + code, return_inverse=True)[1]
    often = np.argsort(-np.bincount(which), kind="stable")
    which = np.argsort(often)[which]
    first = np.zeros(len(often), np.int64)
    first[which] = np.arange(len(which))
    far = np.flatnonzero(which >= 255)
    return np.minimum(which, 255).astype(np.uint8), far.astype(np.uint32), which[far].astype(np.uint32), [c[first].astype(np.int64) for c in columns]


def _kind(at: np.ndarray, which: np.ndarray, far: np.ndarray, number: np.ndarray) -> np.ndarray:
    out = which[at].astype(np.int64)
    apart = np.flatnonzero(out == 255)
    out[apart] = number[np.searchsorted(far, at[apart].astype(np.uint32))]
    return out


def context_file(code: np.ndarray, sums: list[np.ndarray]) -> bytes:
    """Sorted keys of contexts; each names its sums: the total, and the n-grams that count 1, 2, and more."""
    order, index = _keyed(code)
    *which, kinds = _kinds(*[x[order] for x in sums])
    return _array_file(*index, *which, *kinds)


_INDEX = (np.int64, np.uint16, np.uint16, np.uint8, np.uint8)
GRAMS = (*_INDEX, np.uint8, np.uint32, np.int64)
CONTEXTS = (*_INDEX, np.uint8, np.uint32, np.uint32, np.int64, np.int64, np.int64, np.int64)
WORDS = (np.uint64, np.uint8, np.uint32, np.uint32, np.int64, np.int64)


def _word_file(words: np.ndarray, seen: np.ndarray, raw: np.ndarray) -> bytes:
    *which, kinds = _kinds(seen, raw)
    return _array_file(words, *which, *kinds)


def gram_key(code: np.ndarray) -> np.ndarray:
    return mix(code + _U(0x5851F42D4C957F2D)) >> _U(24)


def find(index: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Place of each of the sorted keys in an array file, -1 where it is absent: all keys halve the
    range of their bucket together."""
    steps, within, low, middle, top = index
    if not len(low) or not len(wanted):
        return np.full(len(wanted), -1, np.int64)
    if len(within):
        bucket = (wanted >> _U(24)).astype(np.int64)
        start, end = (steps[b >> 8] + within[b] for b in (bucket, bucket + 1))
    else:
        bucket = (wanted >> _U(32)).astype(np.int64)
        start, end = steps[bucket], steps[bucket + 1]
    rest = (wanted & _U(0xFFFFFF if len(within) else 0xFFFFFFFF)).astype(np.uint32)

    def key(at: np.ndarray) -> np.ndarray:
        out = low[at] | middle[at].astype(np.uint32) << np.uint32(16)
        return out | top[at].astype(np.uint32) << np.uint32(24) if len(top) else out

    left = end - start
    for _ in range(int(left.max()).bit_length()):
        half = left >> 1
        below = key(np.minimum(start + half, len(low) - 1)) < rest
        below &= left > 0
        start = np.where(below, start + half + 1, start)
        left = np.where(below, left - half - 1, half)
    there = np.minimum(start, len(low) - 1)
    return np.where((start < end) & (key(there) == rest), start, -1)


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different code, in their order, and the place of each row's code among them."""
    order = np.argsort(code)
    ranked = code[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(code)]
    back = np.empty(len(code), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


@dataclass
class Model:
    """Where the arrays are, and the totals that every worker needs."""

    folder: str
    order: int
    shards: int
    hot: np.ndarray
    train_tokens: int = 0
    types: int = 0
    #: by order: the discounts of counts 1, 2, 3 and more
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    unigram_total: int = 0
    unigram_rest: float = 1.0

    def path(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard:06d}"


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count of counts is missing, half of the usual step."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


_LEVEL = "kind string, shard int, blob binary, n1 long, n2 long, n3 long, n4 long, types long, total long, tokens long"


def _merge_level(blobs: DataFrame, model: Model, level: int) -> DataFrame:
    """Add up the n-grams of one order by shard, write their arrays, and return the n-grams of
    the next lower order, the sums of the contexts, and the counts of counts."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        known, code, seen, raw = merged_rows(pdf["blob"])
        of = [int((seen == i).sum()) for i in (1, 2, 3, 4)]
        out = [("stat", 0, None, *of, len(code), int(seen.sum()), int(raw.sum()))]
        if level == 1:
            write_shared(model.path("w", shard), _word_file(known[code[:, 0]], seen, raw))
        else:
            write_shared(model.path(f"g{level}", shard), gram_file(fold(known[code]), seen))
            # contexts: rows are sorted, so those of a context stand together
            first = np.flatnonzero(np.concatenate([[True], (code[1:, :-1] != code[:-1, :-1]).any(axis=1)]))
            sums = [np.add.reduceat(x, first) for x in (seen, (seen == 1).astype(np.int64), (seen == 2).astype(np.int64), (seen > 2).astype(np.int64))]
            context = code[first, :-1]
            place = fold(known[context])
            apart = frequent(known[context], model.hot)
            write_shared(model.path(f"c{level}", shard), context_file(place[~apart], [x[~apart] for x in sums]))
            far = _by_shard(known, context[apart], [x[apart] for x in sums], code_shard(place[apart], model.shards))
            out += [("context", s, b, *[0] * 7) for s, b in far]
            # a lower-order n-gram counts its different words to the left; at a text's start, itself
            once = np.where(known[code[:, 1]] == START, seen, 1)
            lower, *sums = add_up(known, code[:, 1:], once, raw)
            out += [("gram", s, b, *[0] * 7) for s, b in _by_shard(known, lower, sums, shard_of(known[lower], model.shards, model.hot))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LEVEL.split(", ")])

    return blobs.groupBy("shard").applyInPandas(work, _LEVEL)


def _write_contexts(blobs: DataFrame, model: Model, level: int) -> int:
    """Write the sums of the contexts whose n-grams are spread; return the number of contexts."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        known, code, *sums = merged_rows(pdf["blob"])
        write_shared(model.path(f"h{level}", int(pdf["shard"].iloc[0])), context_file(fold(known[code]), sums))
        return pd.DataFrame({"contexts": [len(code)]})

    return blobs.groupBy("shard").applyInPandas(work, "contexts long").agg(F.sum("contexts")).first()[0] or 0


def frequent_words(docs: DataFrame, shards: int) -> np.ndarray:
    """START and all words that make up more than half a shard's share of the tokens, none below a quarter.

    Counted on all rows: of every lot of tokens, a task names those words that make up a quarter of a
    shard's share there. What it leaves out of a word is less than that share in all. They decide only
    where n-grams are stored, never what is counted; there are at most 4 * shards.
    """
    if shards == 1:
        return np.zeros(0, np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def send():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            many = n * 4 * shards >= number
            words, n = np.append(words[many], _U(0)), np.append(n[many], number)
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for whole in batches:
            for batch in chunks(whole):
                hashes, _ = word_hashes(*utf8(batch.column("text")))
                held.append(np.maximum(hashes >> _U(16), _U(3)))
                number += len(hashes)
                if number >= FLUSH:
                    yield send()
                    held, number = [], 0
        if number:
            yield send()

    counts = stored(docs.mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total = counts.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where((F.col("word") > 0) & (F.col("n") * F.lit(4 * shards) > total)).select("word").collect()
    return np.unique(np.array([int(START), *[r["word"] for r in rows]], np.uint64))


def train(docs: DataFrame, order: int = 3) -> Model:
    """Count the model on all rows of ``docs`` (text); a null text counts as empty. Repeated rows
    count each. An empty table gives a model that knows nothing: every token is unknown."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / SHARD_BYTES))
    model = Model(shared_path(spark, "lm"), order, shards, frequent_words(texts, shards))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def send():
            known, line = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            line = line.astype(np.uint32)
            starts = np.cumsum([0, *[len(h) for h, _ in held]])
            code, seen = add_up(known, grams(line, np.concatenate([r + a for a, (_, r) in zip(starts, held)]), order), np.ones(number, np.int64))
            for s, blob in _by_shard(known, code, (seen, seen), shard_of(known[code], model.shards, model.hot)):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

        for whole in batches:
            for batch in chunks(whole):
                line, real, _ = tokens(batch, order)
                held.append((line, real))
                number += len(real)
                if number >= FLUSH:
                    yield from send()
                    held, number = [], 0
        if number:
            yield from send()

    blobs, merged = texts.mapInArrow(count, "shard int, blob binary"), None
    for level in range(order, 0, -1):
        merged, before = stored(_merge_level(blobs, model, level), "lm-level"), merged
        if before is not None:
            drop(before)
        s = merged.where("kind = 'stat'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "types", "total", "tokens")]).first()
        d = model.discounts[level] = discounts(s["n1"], s["n2"], s["n3"], s["n4"])
        if level > 1:
            _write_contexts(merged.where("kind = 'context'").select("shard", "blob"), model, level)
            blobs = merged.where("kind = 'gram'").select("shard", "blob")
        elif s["total"]:
            more = s["types"] - s["n1"] - s["n2"]
            model.train_tokens, model.types, model.unigram_total = s["tokens"], s["types"], s["total"]
            model.unigram_rest = (d[0] * s["n1"] + d[1] * s["n2"] + d[2] * more) / s["total"]
    return model


class Reader:
    """Look-ups in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, list[np.ndarray]] = {}

    def _open(self, kind: str, shard: int, kinds: tuple) -> list[np.ndarray] | None:
        path = self.model.path(kind, shard)
        if path not in self.files:
            if len(self.files) >= MAPS:  # the oldest map is closed
                del self.files[next(iter(self.files))]
            data = map_shared(path)
            self.files[path] = None if data is None else _arrays(data, kinds)
        return self.files[path]

    def _each(self, kind: str, kinds: tuple, shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Arrays of each shard that is there, and the rows that ask for it, by their 40-bit keys."""
        order = np.argsort((shard.astype(np.uint64) << _U(40)) | key)
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            if (file := self._open(kind, int(shard[order[a]]), kinds)) is not None:
                yield file, order[a:b]

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest-order and raw counts of sorted words, 0 where they are absent."""
        seen, raw = np.zeros(len(words)), np.zeros(len(words))
        shard = code_shard(fold(words[:, None]), self.model.shards)
        for (known, *which, n, m), rows in self._each("w", WORDS, shard, np.arange(len(words), dtype=np.uint64)):
            at = np.minimum(np.searchsorted(known, words[rows]), len(known) - 1)
            hit = known[at] == words[rows]
            kind = _kind(at[hit], *which)
            seen[rows[hit]], raw[rows[hit]] = n[kind], m[kind]
        return seen, raw

    def contexts(self, level: int, words: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total and weight of the lower order of contexts (with their codes), 0 where they are absent."""
        total, rest = np.zeros(len(code)), np.zeros(len(code))
        key, shard, apart = gram_key(code), code_shard(code, self.model.shards), frequent(words, self.model.hot)
        d = self.model.discounts[level]
        for name, some in ((f"c{level}", np.flatnonzero(~apart)), (f"h{level}", np.flatnonzero(apart))):
            for file, rows in self._each(name, CONTEXTS, shard[some], key[some]):
                rows, index, which, (totals, *ones) = some[rows], file[:5], file[5:8], file[8:]
                at = find(index, key[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                kind = _kind(at, *which)
                total[rows] = totals[kind]
                rest[rows] = sum(n[kind] * x for n, x in zip(ones, d)) / totals[kind]
        return total, rest

    def gram_counts(self, level: int, words: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Counts of n-grams (with their codes), 0 where they are absent."""
        out = np.zeros(len(words), np.int64)
        key = gram_key(code)
        for file, rows in self._each(f"g{level}", GRAMS, shard_of(words, self.model.shards, self.model.hot), key):
            index, (pairs, large, counts) = file[:5], file[5:]
            at = find(index, key[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            small = pairs[at >> 1] >> (4 * (at & 1)).astype(np.uint8) & 15
            out[rows] = small
            full = np.flatnonzero(small == 15)
            out[rows[full]] = counts[np.searchsorted(large, at[full].astype(np.uint32))]
        return out

    def probabilities(self, line: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every real token and its count in the training texts."""
        m = self.model
        vocabulary, which = np.unique(line[real], return_inverse=True)
        seen, raw = self.words(vocabulary)
        d = m.discounts[1]
        base = np.maximum(seen - discount(seen.astype(np.int64), d), 0) / max(1, m.unigram_total) + m.unigram_rest / (m.types + 1)
        p = base[which]
        for level in range(2, m.order + 1):
            rows = grams(line, real, level)
            code = fold(rows)
            first, inverse = distinct(code)
            words = rows[first]
            counts = self.gram_counts(level, words, code[first])
            context = fold(words[:, :-1])
            first, back = distinct(context)
            total, rest = self.contexts(level, words[first, :-1], context[first])
            total, rest = total[back], rest[back]
            high = np.where(total > 0, np.maximum(counts - discount(counts, m.discounts[level]), 0) / np.maximum(total, 1), 0.0)
            p = high[inverse] + np.where(total > 0, rest, 1.0)[inverse] * p
        return p, raw[which]


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` but for text, with n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text (A-Z folded) and one end. n_known counts those that
    training has seen, base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score is the
    log10 probability of the text by the model. A null text counts as empty and has one token.
    Columns of these names are replaced.
    """
    new = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    names = [c for c in docs.columns if c not in (*new, "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _readers.setdefault(model.folder, Reader(model))
        low = math.log10(model.train_tokens + model.types + 1)
        for whole in batches:
            for batch in chunks(whole, limit=4 << 20):
                line, real, firsts = tokens(batch, model.order)
                p, seen = reader.probabilities(line, real)
                text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                add = lambda x: np.bincount(text, x, len(firsts) - 1)
                number = np.diff(firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in names],
                        pa.array(number, pa.int64()),
                        pa.array(add((seen > 0).astype(float)).astype(np.int64)),
                        pa.array(np.full(len(number), model.train_tokens), pa.int64()),
                        pa.array(add(np.log10(seen + 1) - low)),
                        pa.array(add(np.log10(p))),
                    ],
                    [*names, *new],
                )

    schema = docs.select(*names).schema
    for c, kind in new.items():
        schema = schema.add(c, kind)
    return docs.select(*names, "text").mapInArrow(work, schema)
