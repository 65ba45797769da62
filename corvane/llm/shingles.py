"""Hashed word shingles of whole texts, by array operations."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SHARE = 1 << 20  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix((_LOWER.astype(np.uint64) + _U(1)) * _U(_BASE)) | _U(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        ones = np.ones(1, np.uint64)
        _POWERS[:] = [np.cumprod(np.concatenate([ones, np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * power[:-1])])
    return mix((total[end] - total[start]) * inverse[start])


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, in order."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= _SHARE:
        return _word_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + _SHARE, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # a part ends where a word does
            further = np.flatnonzero(_SPACE[data[end : end + _SHARE]])
            end = end + int(further[0]) if len(further) else min(end + _SHARE, len(data))
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words; of fewer words, one hash of all; of none, nothing."""
    w = word_hashes(raw)
    n = len(w)
    if not n:
        return w
    size = min(n, WORDS)
    s = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        s = s * _U(0xD6E8FEB86659FD93) + w[k : n - size + 1 + k]
    return np.unique(mix(s))
