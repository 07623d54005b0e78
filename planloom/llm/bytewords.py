"""Words of many texts at once, as numbers: hashes of byte stretches by NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go. Longer texts are cut between words, never inside one.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(raw: bytes) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[np.frombuffer(raw, np.uint8)]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[:len(data)], dtype=np.uint64)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of every word of one byte array."""
    if len(data) <= CHUNK:
        return _hashed(data)
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            while end < len(data) and not _BLANK[data[end]]:
                end += 1
        h, s, e = _hashed(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def texts_in_chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about CHUNK bytes: (first, last, data, hashes, starts, ends, borders). Text
    first + k has the words borders[k] to borders[k + 1]."""
    at = 0
    while at < len(texts):
        last, total = at, 0
        while last < len(texts) and (last == at or total + len(texts[last]) <= CHUNK):
            total += len(texts[last]) + 1
            last += 1
        data = lowered(b" ".join(texts[at:last]))
        hashes, starts, ends = words(data)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[at:last]])))
        yield at, last, data, hashes, starts, ends, np.searchsorted(starts, begins)
        at = last
