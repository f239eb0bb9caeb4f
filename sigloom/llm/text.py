"""Vectorised text helpers used inside tasks, and column expressions for words.

A word is a run of bytes other than space and 0x09-0x0D. Word hashes fold A-Z to a-z.
Everything works on whole texts; a batch is cut into chunks of bounded bytes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHUNK_BYTES = 1 << 20

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same in every process."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null counts as empty) and the offset of each text in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose texts have about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
        if n > 8 * CHUNK_BYTES:  # of a single very long text: not kept
            del _powers[name]
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z folded), and the index of each text's first word."""
    starts, ends, firsts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power("up", _BASE, len(data))[: len(data)], out=running[1:])
    raw = (running[ends] - running[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64)), firsts


def n_words(text: Column) -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's text, modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))
