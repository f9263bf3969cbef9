"""Vectorised word and k-mer hashes of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_CHUNK = 1 << 20


def _power(base: int, size: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    if len(_powers.get(base, ())) < size:
        _powers[base] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(size, _CHUNK) - 1, base, np.uint64))))
    return _powers[base][:size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(raw: np.ndarray) -> np.ndarray:
    space = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)))))
    return mixed((sums[stops] - sums[starts]) * _power(_INVERSE, len(raw))[starts] + (stops - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word between ASCII white space, A-Z lower-cased; long texts go in parts cut at white space."""
    data = (text or "").encode("utf-8", "replace").lower()
    raw = np.frombuffer(data, np.uint8)
    parts, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + _CHUNK)
        while stop < len(raw) and not _SPACE[raw[stop]]:
            rest = np.flatnonzero(_SPACE[raw[stop:stop + _CHUNK]])
            stop = stop + int(rest[0]) if len(rest) else min(len(raw), stop + _CHUNK)
        parts.append(_hashes(raw[at:stop]))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; its order counts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + words[j:j + n]
    return mixed(total)


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of window values, by runs of 1, 2, 4, ... of them."""
    size, least = 1, values
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = window - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some window of neighbours: each window has one."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, np.int64)
    ends = np.zeros(window - 1, np.uint64)  # a position counts if some window over it has it as its least
    most = ~_least(~np.concatenate((ends, _least(hashes, window), ends)), window)
    return np.flatnonzero(hashes == most)
