"""Polynomial hashes of strings, words and word windows, computed over whole blocks of texts with array operations."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial modulo 2^64, and the inverse powers that shift each string to the origin."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=sums[1:])
    return sums, _powers[1]


def string_hash(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, size) -> np.ndarray:
    return mix(((sums[begin + size] - sums[begin]) * inverse[begin]) ^ np.asarray(size, np.uint64))


def blocks(rows, size, most: int = 1 << 18):
    """Rows in lists of about `most` bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def joined(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)


def words(texts: list[bytes], separators: np.ndarray = _SPACE, data: np.ndarray | None = None):
    """(text, hash, begin, end in the joined bytes) of every word of these texts; words don't cross texts. `data`: hash these
    bytes, of the same length, for the joined ones."""
    data = joined(texts) if data is None else data
    out = np.r_[True, separators[data]]
    begin = np.flatnonzero(out[:-1] & ~out[1:])
    end = np.flatnonzero(~out[:-1] & out[1:])
    sums, inverse = prefix(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, begin, side="right"), string_hash(sums, inverse, begin, end - begin), begin, end


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` neighbouring word hashes, in order."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 2**64) | 1)
    return mix(total)
