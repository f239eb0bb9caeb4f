"""Counting quotient filters: exact counters of integers in little more than their remainders.

An integer of ``bits`` bits is permuted invertibly, so that equal shares of the range hold about
equal numbers of keys. Its upper bits, the quotient, are only told by where the key stands: a bit
vector has, for every quotient in order, a one for each of its keys and then a zero. The lower
bits, the remainder, are kept in full, so nothing is lost and the permutation gives the key back.
A counter is a byte; counts of 255 and more are kept apart. A filter lists its keys in ascending
permuted order, so filters of one range are merged like sorted runs.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _steps(bits: int) -> tuple[np.uint64, np.uint64]:
    return _U((1 << bits) - 1), _U((bits + 1) // 2)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the integers below 2**bits that spreads their bits."""
    mask, half = _steps(bits)
    for factor in _FACTORS:
        keys = (keys * _U(factor)) & mask
        keys = keys ^ (keys >> half)
    return keys


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of ``permute``."""
    mask, half = _steps(bits)
    for factor in reversed(_FACTORS):
        keys = keys ^ (keys >> half)  # its own inverse, since half is at least bits / 2
        keys = (keys * _U(pow(factor, -1, 1 << 64))) & mask
    return keys


def encode(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of ascending distinct permuted keys below 2**bits and their counts."""
    n = len(keys)
    remainder = min(64, 8 * -(-max(0, bits - max(0, n.bit_length() - 1)) // 8))
    quotient = max(0, bits - remainder)
    q = (keys >> _U(remainder)).astype(np.int64) if remainder < 64 else np.zeros(n, np.int64)
    runs = np.zeros(n + (1 << quotient), np.uint8)
    runs[np.arange(n) + q] = 1
    rest = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : remainder // 8]
    large = np.flatnonzero(counts >= 255)
    head = np.array([n, quotient, remainder, len(large)], np.int64)
    parts = [head, np.packbits(runs), rest, np.minimum(counts, 255).astype(np.uint8), large.astype(np.int64), counts[large].astype(np.int64)]
    return b"".join(p.tobytes() for p in parts)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys and counts of a filter."""
    n, quotient, remainder, large = np.frombuffer(data, np.int64, 4).tolist()
    at, width, slots = 32, remainder // 8, n + (1 << quotient)
    runs = np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at), count=slots)
    at += -(-slots // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    keys = wide.view(np.uint64).ravel()
    if remainder < 64:
        keys = keys | ((np.flatnonzero(runs) - np.arange(n)).astype(np.uint64) << _U(remainder))
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    where = np.frombuffer(data, np.int64, large, at)
    counts[where] = np.frombuffer(data, np.int64, large, at + 8 * large)
    return keys, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and added-up counts of several filters of one range."""
    parts = [decode(f) for f in filters]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")  # finds the sorted runs and merges them
    return add_up(keys[order], counts[order])


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of an ascending array with the sums of their counts."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)
