"""Suffix arrays by induced sorting, one array operation per bucket, for the shards of a distributed job."""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The end of the text is the smallest suffix."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[n - 1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of smaller suffixes after a larger one."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _deal(positions: np.ndarray, text: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append positions, in order, to the buckets of their symbols."""
    symbol = text[positions]
    order = np.argsort(symbol, kind="stable")
    positions, symbol = positions[order], symbol[order]
    cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    bounds = [0, *cut.tolist(), len(positions)]
    for i in range(len(bounds) - 1):
        into[symbol[bounds[i]]].append(positions[bounds[i] : bounds[i + 1]])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(text: np.ndarray, smaller: np.ndarray, first: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the order ``first`` of the leftmost smaller positions induces.

    Buckets are taken in ascending order for the larger suffixes and in
    descending order for the smaller ones. A bucket's entries are looked at all
    at once; those that fall into the same bucket are the next round's.
    """
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    if len(first):
        _deal(first, text, seeds)
    larger[text[-1]].append(np.array([len(text) - 1]))  # what the end induces

    def before(entries: np.ndarray, kind: bool) -> np.ndarray:
        prior = entries[entries > 0] - 1
        return prior[smaller[prior] == kind]

    for c in range(symbols):
        seen = _joined(larger[c])
        current, done = seen, [seen]
        while len(current):
            prior = before(current, False)
            same = text[prior] == c
            if (~same).any():
                _deal(prior[~same], text, larger)
            current = prior[same]
            done.append(current)
        larger[c] = [_joined(done)]
        if seeds[c]:
            prior = before(_joined(seeds[c]), False)
            if len(prior):
                _deal(prior, text, larger)

    least: list[list[np.ndarray]] = [[] for _ in range(symbols)]  # from the right end of each bucket
    for c in range(symbols - 1, -1, -1):
        seen = _joined(least[c])
        current, done = seen, [seen]
        while len(current):
            prior = before(current, True)
            same = text[prior] == c
            if (~same).any():
                _deal(prior[~same], text, least)
            current = prior[same]
            done.append(current)
        prior = before(larger[c][0][::-1], True)
        # A larger suffix of this bucket precedes no smaller one of the same bucket.
        if len(prior):
            _deal(prior, text, least)
        least[c] = [_joined(done)]
    return np.concatenate([x for c in range(symbols) for x in (larger[c][0], least[c][0][::-1])])


def names_of(text: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of the sorted substrings that reach from one leftmost smaller position to the next; equal ones share one."""
    n = len(text)
    end = np.append(start[1:], n - 1)
    length = end - start
    place = np.searchsorted(start, order)
    a, b = order[:-1], order[1:]
    la, lb = length[place[:-1]], length[place[1:]]
    same = la == lb
    active = np.flatnonzero(same)
    k = 0
    while len(active):
        differ = text[a[active] + k] != text[b[active] + k]
        same[active[differ]] = False
        active = active[~differ]
        active = active[la[active] > k]
        k += 1
    if len(order) > 1:  # the last substring ends with the text and equals none
        same &= (place[:-1] != len(start) - 1) & (place[1:] != len(start) - 1)
    name = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(start), np.int64)
    out[place] = name
    return out


def reduced_order(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of the reduced string, by pairs of names, pairs of pairs and so on, to ``depth`` names."""
    rank, width = names, 1
    while width < depth and int(rank.max()) + 1 < len(rank):
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-width] = rank[width:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Positions of all suffixes of ``text``, ordered by their first ``depth`` symbols at least.

    Suffixes are classified, the leftmost smaller substrings are sorted by
    induction and named, the reduced string of names is ordered in the same
    manner by ever longer names, and its order induces that of all suffixes.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    smaller = suffix_types(text)
    start = leftmost_smaller(smaller)
    if len(start):
        rough = induce(text, smaller, start, symbols)
        is_start = np.zeros(len(text), bool)
        is_start[start] = True
        order = rough[is_start[rough]]
        names = names_of(text, order, start)
        if int(names.max()) + 1 < len(start):
            order = start[reduced_order(names, depth // 2 + 2)]
        start = order
    return induce(text, smaller, start, symbols)


def permuted_common(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions ``order`` have ``length`` bytes in common with the one before them, as read in text order.

    ``text`` are bytes, ``order`` sorted positions that have so many bytes.
    Words of eight bytes are compared while they are equal.
    """
    out = np.zeros(len(order), bool)
    if len(order) < 2:
        return out
    words = np.lib.stride_tricks.as_strided(text[:8].view(np.uint64), (len(text) - 7,), (1,)) if len(text) >= 8 else None
    by_text = np.argsort(order[1:], kind="stable")
    here, other = order[1:][by_text], order[:-1][by_text]
    active = np.arange(len(here))
    for k in [*range(0, length - 7, 8), length - 8]:
        active = active[words[here[active] + k] == words[other[active] + k]]
        if not len(active):
            break
    out[1 + by_text[active]] = True
    return out
