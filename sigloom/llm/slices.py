"""Hashes and copies of many byte slices at once, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sigloom.llm.text import mix

_U = np.uint64
_BASE = _U(0xD1342543DE82EF95)  # odd, so that it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_KEPT = 1 << 21


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _KEPT), _powers(_INVERSE, _KEPT)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice ``data[start:end]``, from one running polynomial sum."""
    n = len(data)
    up, down = (_UP, _DOWN) if n < _KEPT else (_powers(_BASE, n), _powers(_INVERSE, n + 1))
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def take_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The slices as a string or binary array."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    source = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    wide = pa.large_string() if pa.types.is_string(kind) else pa.large_binary()
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[source]))]
    return pa.Array.from_buffers(wide, len(starts), buffers).cast(kind)


class Tally:
    """Counts of hashed things with the columns that name them, added up in a task until they are
    more than ``limit`` different ones."""

    def __init__(self, limit: int):
        self.limit, self.number = limit, 0
        self.held: list[tuple[np.ndarray, np.ndarray, tuple[pa.Array, ...]]] = []

    def add(self, codes: np.ndarray, counts: np.ndarray, *names: pa.Array) -> None:
        """Different codes, how often each occurs, and its names."""
        self.held.append((codes, counts, names))
        self.number += len(codes)

    def full(self) -> bool:
        """Whether there is too much to hold, after adding up what several additions share."""
        if self.number >= self.limit and len(self.held) > 1:
            self.held = [self.take()]
            self.number = len(self.held[0][0])
        return self.number >= self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray, tuple[pa.Array, ...]]:
        """All that is held, by ascending code; nothing is held afterwards."""
        codes, first, inverse = np.unique(np.concatenate([h[0] for h in self.held]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([h[1] for h in self.held]), len(codes)).astype(np.int64)
        names = tuple(pa.concat_arrays(n).take(pa.array(first)) for n in zip(*[h[2] for h in self.held]))
        self.held, self.number = [], 0
        return codes, counts, names

    def batch(self, *labels: str) -> pa.RecordBatch:
        codes, counts, names = self.take()
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), *names, pa.array(counts)], ["code", *labels, "n"])
