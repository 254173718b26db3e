"""Suffix arrays by recursive induced sorting, with whole buckets induced at a time, and permuted prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost S suffixes
of each run sort all others: scanning buckets in order, every sorted suffix places the one that
starts a byte before it. A bucket's scan is done in waves of whole arrays: what a wave places in its
own bucket forms the next wave, which keeps the order of the sequential scan, so the work stays
linear and the number of waves is the longest run of a byte.
"""

from __future__ import annotations

import math

import numpy as np

#: Names of a reduced string that are ordered without another recursion.
SHORT = 1 << 18


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last counts as S."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = np.append(s[:-1] < s[1:], True)
    return smaller[nxt]


class _Buckets:
    """Growing lists of suffixes for each first symbol."""

    def __init__(self, symbols: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def add(self, suffixes: np.ndarray, first: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(first, kind="stable")
        suffixes, first = suffixes[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        start = 0
        for stop in [*cuts.tolist(), len(first)]:
            self.parts[first[start]].append(suffixes[start:stop])
            start = stop

    def get(self, symbol: int) -> np.ndarray:
        part = self.parts[symbol]
        if len(part) != 1:
            self.parts[symbol] = part = [np.concatenate(part) if part else np.zeros(0, np.int32)]
        return part[0]


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes, sorted as far as the given order of the leftmost S suffixes decides."""
    starts = _Buckets(symbols)
    starts.add(lms, s[lms])
    larger, smaller = _Buckets(symbols), _Buckets(symbols)

    def place(wave: np.ndarray, want_s: bool, into: _Buckets, symbol: int) -> np.ndarray:
        before = wave[wave > 0] - 1
        before = before[is_s[before] == want_s]
        first = s[before]
        own = first == symbol
        into.add(before[~own], first[~own])
        return before[own]

    for c in range(symbols):
        wave = larger.get(c)
        waves = [wave]
        while len(wave):
            wave = place(wave, False, larger, c)
            waves.append(wave)
        larger.parts[c] = waves
        place(starts.get(c), False, larger, c)
    for c in range(symbols - 1, -1, -1):
        wave = smaller.get(c)
        waves = [wave]
        while len(wave):
            wave = place(wave, True, smaller, c)
            waves.append(wave)
        smaller.parts[c] = waves
        place(larger.get(c)[::-1], True, smaller, c)
    last = np.array([len(s) - 1], np.int32)  # the sentinel has no successor to place it
    return np.concatenate([last, *(x for c in range(symbols) for x in (larger.get(c), smaller.get(c)[::-1]))])


def _names(s: np.ndarray, lms: np.ndarray, by_order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost S suffixes, by text order; equal ones share a rank."""
    length = np.append(np.diff(lms) + 1, 1)
    at = np.empty(len(s), np.int32)
    at[lms] = np.arange(len(lms))
    a, b = by_order[:-1], by_order[1:]
    same = length[at[a]] == length[at[b]]
    active, size = np.flatnonzero(same), length[at[b]]
    offset = 0
    while len(active):
        active = active[size[active] > offset]
        if not len(active):
            break
        equal = s[a[active] + offset] == s[b[active] + offset]
        same[active[~equal]] = False
        active = active[equal]
        offset += 1
    rank = np.empty(len(lms), np.int64)
    rank[at[by_order]] = np.append(0, np.cumsum(~same))
    return rank


def _short_order(rank: np.ndarray) -> np.ndarray:
    """Suffix order by names of pairs, pairs of pairs and so on until all differ: the recursion's end."""
    n, step = len(rank), 1
    while rank.max() < n - 1:
        shifted = np.zeros(n, np.int64)
        shifted[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + shifted, return_inverse=True)
        step *= 2
    return np.argsort(rank, kind="stable")


def _order_of_names(rank: np.ndarray) -> np.ndarray:
    """Suffix order of the reduced string: by induced sorting again, and where it is short by doubling.

    For the recursion names are written as two digits of a base near the square root of their number,
    which keeps their order and the buckets few; every other suffix of what is written begins a name.
    """
    names = int(rank.max()) + 1
    if names == len(rank):
        return np.argsort(rank)
    if len(rank) <= SHORT:
        return _short_order(rank)
    base = math.isqrt(names - 1) + 1
    digits = np.empty(2 * len(rank) + 1, np.int32)
    digits[:-1:2], digits[1::2], digits[-1] = rank // base + 1, rank % base + 1, 0
    order = suffix_array(digits)
    return order[(order % 2 == 0) & (order < 2 * len(rank))] // 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions in suffix order; s ends with its only and smallest symbol 0."""
    symbols = int(s.max()) + 1
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(lms) <= 1:  # the sentinel alone, or nothing but the sentinel
        return _induce(s, is_s, lms, symbols)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    rough = _induce(s, is_s, lms, symbols)
    rank = _names(s, lms, rough[is_lms[rough]])
    return _induce(s, is_s, lms[_order_of_names(rank)], symbols)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """Length of the common prefix of each suffix with its predecessor in order, by text position.

    Prefixes end before the symbol ``stop`` and below it. Only positions whose preceding symbols
    differ are compared; every other value is one less than that of the position before.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    before = np.where(phi > 0, s[np.maximum(phi, 1) - 1], -1)
    own = np.where(here > 0, s[np.maximum(here, 1) - 1], -2)
    reducible = (own == before) & (own > stop)
    value = np.zeros(n, np.int64)
    active = np.flatnonzero(~reducible & (phi >= 0))
    offset = 0
    while len(active):
        x, y = active + offset, phi[active] + offset
        ok = (x < n) & (y < n)
        active, x, y = active[ok], x[ok], y[ok]
        equal = (s[x] == s[y]) & (s[x] > stop)
        active = active[equal]
        value[active] += 1
        offset += 1
    anchor = np.maximum.accumulate(np.where(reducible, -1, here))
    return np.where(reducible, np.maximum(value[anchor] - (here - anchor), 0), value)
