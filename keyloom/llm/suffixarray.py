"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one; the leftmost S ones (LMS) are sorted by inducing from
any order of their first symbols, named, sorted by recursion on the names, and induce the order of all others. Over a small
alphabet a whole bucket is induced at once with array operations; the recursion's large alphabets are scanned.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 2048


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The last symbol is a unique smallest one and S."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    s = np.zeros(n, bool)
    s[-1] = True
    if len(differs):  # every position takes the type that the next change of symbol decides
        s[: differs[-1] + 1] = np.repeat(t[differs] < t[differs + 1], np.diff(np.r_[-1, differs]))
    return s


def _put(sa: np.ndarray, at: np.ndarray, found: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Append `found` in order to the buckets of their symbols; `at` holds the next free place, moving by `step`."""
    order = np.argsort(symbols, kind="stable")
    ch = symbols[order]
    first = np.flatnonzero(np.r_[True, ch[1:] != ch[:-1]])
    n = np.diff(np.r_[first, len(ch)])
    rank = np.arange(len(ch)) - np.repeat(first, n)
    sa[at[ch] + step * rank] = found[order]
    at[ch[first]] += step * n


def _induce_buckets(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(t)
    total = np.bincount(t, minlength=size)
    ends = np.cumsum(total)
    starts = ends - total
    sa = np.full(n, -1, np.int64)
    of_lms = np.bincount(t[lms], minlength=size)
    lms_end = np.cumsum(of_lms)  # lms is in the order of its buckets
    heads = starts.copy()
    for c in np.flatnonzero(total):
        wave = sa[starts[c] : heads[c]]
        while len(wave):
            before = wave[wave > 0] - 1
            symbols = t[before]
            up = symbols > c
            if up.any():
                _put(sa, heads, before[up], symbols[up], 1)
            wave = before[symbols == c]
            sa[heads[c] : heads[c] + len(wave)] = wave
            heads[c] += len(wave)
        own = lms[lms_end[c] - of_lms[c] : lms_end[c]]
        own = own[own > 0] - 1
        if len(own):
            _put(sa, heads, own, t[own], 1)
    tails = ends - 1
    sa[0], tails[t[-1]] = n - 1, tails[t[-1]] - 1
    for c in np.flatnonzero(total)[::-1]:
        wave = sa[tails[c] + 1 : ends[c]][::-1]
        while len(wave):
            before = wave[wave > 0] - 1
            symbols = t[before]
            down = symbols < c
            if down.any():
                _put(sa, tails, before[down], symbols[down], -1)
            wave = before[(symbols == c) & is_s[before]]
            sa[tails[c] - len(wave) + 1 : tails[c] + 1] = wave[::-1]
            tails[c] -= len(wave)
        larger = sa[starts[c] : heads[c]][::-1]
        larger = larger[larger > 0] - 1
        larger = larger[t[larger] < c]
        if len(larger):
            _put(sa, tails, larger, t[larger], -1)
    return sa


def _induce_scan(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n, ends = len(t), np.cumsum(np.bincount(t, minlength=size))
    heads, tails = np.r_[0, ends[:-1]].tolist(), ends.tolist()
    before = np.r_[-1, t[:-1]]  # the symbol on the left; -1 where the suffix there isn't of the type that is induced
    larger, smaller = before.copy(), before.copy()
    larger[1:][is_s[:-1]] = -1
    smaller[1:][~is_s[:-1]] = -1
    larger, smaller = larger.tolist(), smaller.tolist()
    sa = np.zeros(n, np.int64)  # 0: empty or the first suffix, neither induces
    symbols = t[lms]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    count = np.diff(np.r_[first, len(lms)])
    sa[np.repeat(ends[symbols[first]] - count - first, count) + np.arange(len(lms))] = lms
    sa = sa.tolist()
    for j in sa:  # the list grows ahead of the scan
        c = larger[j]
        if c >= 0:
            k = heads[c]
            sa[k] = j - 1
            heads[c] = k + 1
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            k = tails[c] - 1
            sa[k] = j - 1
            tails[c] = k
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _equal_substrings(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a:a+length] equals t[b:b+length], pair by pair."""
    equal = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        same = t[a[live] + k] == t[b[live] + k]
        equal[live[~same]] = False
        k += 1
        live = live[same & (length[live] > k)]
    return equal


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Of symbols below `size`; the last symbol must be 0 and occur nowhere else."""
    t = np.ascontiguousarray(t, np.int64)
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int64)
    induce = _induce_buckets if size <= SMALL else _induce_scan
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    sa = induce(t, is_s, lms[np.argsort(t[lms], kind="stable")], size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_rank = sa[is_lms[sa]]
    span = np.zeros(n, np.int64)
    span[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = by_rank[:-1], by_rank[1:]
    same = span[a] == span[b]
    if len(a):
        same[0] = False  # the last symbol alone
        which = np.flatnonzero(same)
        same[which] = _equal_substrings(t, a[which], b[which], span[a[which]])
    names = np.r_[0, np.cumsum(~same)]
    if names[-1] + 1 < len(lms):
        name_of = np.zeros(n, np.int64)
        name_of[by_rank] = names
        by_rank = lms[suffix_array(name_of[lms], int(names[-1]) + 1)]
    return induce(t, is_s, by_rank, size)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position, the suffix before it in the array and their common prefix. Only positions whose left
    symbols differ (irreducible) are compared; each other one is its left neighbour's value less 1."""
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    reducible &= np.r_[False, phi[:-1] >= 0]
    irreducible = np.flatnonzero(~reducible)
    value = np.zeros(len(irreducible), np.int64)
    live = np.flatnonzero(phi[irreducible] >= 0)
    a, b = irreducible[live], phi[irreducible[live]]
    far = np.r_[t.astype(np.int32), np.full(32, -1, np.int32)]
    step = 0
    while len(live):  # at a difference the rest of the block is not equal; the unique last symbol stops every pair
        equal = far[a + step] == far[b + step]
        value[live[equal]] += 1
        live, a, b = live[equal], a[equal], b[equal]
        step += 1
    last = np.cumsum(~reducible) - 1
    plcp = np.maximum(value[last] - (i - irreducible[last]), 0)
    return phi, plcp


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, a mask over its starts: whether the `length` bytes from there also start anywhere else in these segments."""
    if not segments:
        return []
    sizes = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes)
    t = np.append(np.insert(data, ends, 1), 0)  # 1 ends each segment, 0 the whole
    begins = ends - sizes + np.arange(len(sizes))
    sa = suffix_array(t, 258)
    _, plcp = permuted_common_prefixes(t, sa)
    long = plcp >= length
    found = long.copy()
    ranked = sa[1:]
    found[sa[:-1][long[ranked]]] = True
    return [found[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes)]
