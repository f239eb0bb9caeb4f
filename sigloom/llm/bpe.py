"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokenisation uses no regular expression. Code points become classes by table look-up; the
boundaries follow from a small automaton over the classes. Its transition functions compose
associatively, so a text is cut into blocks, every block is run from all states at once, the
block functions are composed, and a last pass emits the boundaries. The slices between them are
merged by rank through a cache; token lengths give the byte offset of each token, and ids turn
back into bytes by one gather.

The pattern that is followed: contractions 's 't 're 've 'm 'll 'd; an optional space and a run
of letters, of numbers, or of other visible characters; white space up to the last one before a
visible character; other white space.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigloom.llm.text import chunks

# Classes of a code point. Apostrophes that may open a contraction of 2 or 3 characters and
# white space that stands right before a visible character are told apart by their neighbours.
LETTER, NUMBER, OTHER, SPACE, GLUE, SOLO, TWO, THREE = range(8)
# States: what the character just read belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_GLUE, ONE_LEFT, TWO_LEFT = range(8)
LANE = 1024
#: The Unicode property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: Slices up to this length are cached, in a young and an old half; a full young half becomes the
#: old one, and what is found in the old half moves to the young.
CACHED_CHARS, CACHE_SIZE = 48, 1 << 17
SHORT_BYTES = 128


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, mark in (("L", LETTER), ("N", NUMBER)):
        table[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == kind]] = mark
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a token starts, by class * 8 + state."""
    step, start = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for state in range(8):
        if state in (ONE_LEFT, TWO_LEFT):  # the rest of a contraction, whatever it is
            step[:, state] = FRESH if state == ONE_LEFT else ONE_LEFT
            start[:, state] = False
            continue
        for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
            step[kind, state] = run
            start[kind, state] = state not in (run, AFTER_GLUE)
        for kind, rest in ((TWO, ONE_LEFT), (THREE, TWO_LEFT)):
            # an apostrophe inside a run of other characters, or after a space, is one of them
            joins = state in (IN_OTHER, AFTER_GLUE)
            step[kind, state] = IN_OTHER if joins else rest
            start[kind, state] = not joins
        step[SPACE, state], start[SPACE, state] = IN_SPACE, state != IN_SPACE
        step[GLUE, state] = AFTER_GLUE
        step[SOLO, state] = FRESH
    return step.ravel(), start.ravel()


def _kinds(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of every code point; ``ends``: exclusive end of each text in ``points``."""
    kinds = _classes()[points]
    white = kinds == SPACE
    before_visible = np.zeros(len(points), bool)
    before_visible[:-1] = white[:-1] & ~white[1:]
    before_visible[ends[ends > 0] - 1] = False
    kinds[before_visible] = np.where(points[before_visible] == 0x20, GLUE, SOLO)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        room = ends[np.searchsorted(ends, quotes, side="right")] - quotes
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = (room >= 3) & (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        )
        single = (room >= 2) & np.isin(one, [ord(c) for c in "stmd"])
        kinds[quotes[pair]] = THREE
        kinds[quotes[single]] = TWO
    return kinds


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index of the first code point of every token; tokens never cross the end of a text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    step, start = _automaton()
    kinds = _kinds(points, ends)
    opens = np.zeros(n, bool)
    opens[0] = True
    inner = ends[ends < n]
    opens[inner] = True
    lanes = -(-n // LANE)
    code = np.full(lanes * LANE, SPACE, np.uint8)
    code[:n] = kinds
    code = (code.reshape(lanes, LANE).T << 3).copy()
    fresh = np.zeros(lanes * LANE, bool)
    fresh[:n] = opens
    fresh = fresh.reshape(lanes, LANE).T.copy()
    any_fresh = fresh.any(axis=1)
    # the function of every block: its last state from each first state
    state = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    for i in range(LANE):
        if any_fresh[i]:
            state[:, fresh[i]] = FRESH
        state = step[code[i] | state]
    entry = np.empty(lanes, np.uint8)
    now = FRESH
    for lane in range(lanes):
        entry[lane] = now
        now = state[now, lane]
    found = np.empty((LANE, lanes), bool)
    for i in range(LANE):
        if any_fresh[i]:
            entry[fresh[i]] = FRESH
        at = code[i] | entry
        found[i] = start[at]
        entry = step[at]
    return np.flatnonzero((found.T.ravel()[:n]) | opens)


class Codec:
    """Encoder and decoder of one rank file: lines of a base64 token and its rank."""

    def __init__(self, lines: list[str]):
        pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = sorted((rank, token) for token, rank in self.ranks.items())
        self.lengths = np.zeros(tokens[-1][0] + 1, np.int64)
        for rank, token in tokens:
            self.lengths[rank] = len(token)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token for _, token in tokens), np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        #: rank of a joined pair, by left id << 32 | right id
        self.pairs = {
            self.ranks[token[:i]] << 32 | self.ranks[token[i:]]: rank
            for rank, token in tokens
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        }

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Join the adjacent pair of lowest rank, leftmost first, until none is in the file."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(piece) <= SHORT_BYTES:
            return self._merge_short(piece)
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            middle = end[i] if alive[i] else n
            if not alive[i] or middle >= n or end[middle] != stop:
                continue  # one of the two has changed
            end[i], alive[middle] = stop, False
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        """The same on plain lists, which is faster while they are short."""
        pairs, none = self.pairs.get, 1 << 62
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        ranks = [pairs(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i] = low
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs(ids[i - 1] << 32 | low, none)
            if i < len(ranks):
                ranks[i] = pairs(low << 32 | ids[i + 1], none)
        return tuple(ids)

    def ids(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            got = self.old.get(piece) or self.merge(piece.encode())
            if len(piece) <= CACHED_CHARS:
                self.cache[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the index of each text's first id."""
        whole = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        starts = boundaries(np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends)
        cuts = starts.tolist() + [len(whole)]
        if len(self.cache) >= CACHE_SIZE:
            self.cache, self.old = {}, self.cache
        get, ids = self.cache.get, self.ids
        parts = [get(p) or ids(p) for p in map(whole.__getitem__, map(slice, cuts, cuts[1:]))]
        counts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=counts[1:])
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(counts[-1]))
        firsts = np.concatenate([[0], counts[np.searchsorted(starts, ends)]])
        return flat, firsts

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every token and, last, the number of bytes."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.lengths[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        offsets = self.offsets(ids)
        source = np.arange(offsets[-1]) + np.repeat(self.begins[ids] - offsets[:-1], self.lengths[ids])
        return self.bytes[source].tobytes()


_codecs: dict[int, Codec] = {}


def _codec(lines) -> Codec:
    """One codec for each rank file and worker process."""
    key = hash(tuple(lines[:50])) ^ len(lines)
    if key not in _codecs:
        _codecs[key] = Codec(lines)
    return _codecs[key]


def read_ranks(path: str) -> list[str]:
    """Lines of a rank file; a vocabulary has a fixed size of some ten thousand tokens."""
    with open(path, encoding="ascii") as file:
        return file.read().splitlines()


ENCODED = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "byte_offsets": pa.list_(pa.int64()),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
_DDL = {"n_tokens": "long", "ids": "array<int>", "byte_offsets": "array<long>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, ranks: list[str], columns: tuple[str, ...] = ("n_tokens", "ids", "byte_offsets")) -> DataFrame:
    """doc_id and the wanted columns of ``ENCODED`` for every row of ``docs`` (doc_id, text).

    A null or empty text has no tokens. A text is encoded whole, in batches of bounded bytes; a
    text longer than a batch stands alone. ``byte_offsets`` has the start of each token in the
    UTF-8 text and, last, its length. Rows that repeat are encoded each; other columns are left.
    """
    lines = docs.sparkSession.sparkContext.broadcast(ranks)  # of the vocabulary's fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value)
        for whole in batches:
            for batch in chunks(whole):
                flat, firsts = codec.encode([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[_column(codec, c, flat, firsts) for c in columns]], ["doc_id", *columns]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} {_DDL[c]}" for c in columns]])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _column(codec: Codec, name: str, flat: np.ndarray, firsts: np.ndarray) -> pa.Array:
    spans = list(zip(firsts[:-1].tolist(), firsts[1:].tolist()))
    if name == "n_tokens":
        return pa.array(np.diff(firsts), pa.int64())
    if name == "ids":
        return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(flat.astype(np.int32)))
    if name == "byte_offsets":
        return pa.array([codec.offsets(flat[a:b]) for a, b in spans], ENCODED[name])
    if name == "ids_sha256":
        raw = flat.astype("<u4")
        return pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in spans])
    return pa.array([hashlib.sha256(codec.decode(flat[a:b])).hexdigest() for a, b in spans])


def decode(encoded: DataFrame, ranks: list[str]) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text. Bytes that are no UTF-8
    (ids cut in the middle of a character) become replacement characters."""
    lines = encoded.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(lines.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")
