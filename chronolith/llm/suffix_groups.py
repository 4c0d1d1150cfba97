"""Suffix sorting by linear grouping construction.

Groups of suffixes are taken in descending order. Each suffix of a group looks up its previous smaller suffix, the
nearest one to its left in a lower group. Suffixes that were so reached equally often leave their group together
for a new one right above it, so in the end a group holds the suffixes with one Lyndon prefix. Then the groups' own
order is emitted along the same pointers. Nothing is renamed recursively and no suffixes are compared.

``sort_suffixes`` orders the suffixes of any one string. ``ordered_columns`` is for many strings that are aligned:
their symbols are ordered by column first, so the previous smaller suffix of every suffix is the one a column before
it and the groups of one column don't reach each other. All of them are taken at once, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sort_suffixes(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` (symbols from 0 up) in ascending order; a suffix precedes those it begins."""
    n = len(s)
    members: list[list[int]] = [[] for _ in range(max(s, default=-1) + 1)]  # starts in ascending order
    for i, x in enumerate(s):
        members[x].append(i)
    group = list(s)
    below, above = {g: g - 1 for g in range(len(members))}, {g: g + 1 for g in range(len(members))}
    smaller = [-1] * n  # previous smaller suffix
    done = [False] * len(members)
    here = len(members) - 1
    while here >= 0:
        reached: dict[int, int] = {}
        own = members[here] = [i for i in members[here] if group[i] == here]  # others have left
        done[here] = True
        for i in own:
            p = i - 1
            while p >= 0 and done[group[p]]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        often: list[list[int]] = [[] for _ in range(max(reached.values(), default=0) + 1)]
        for p, times in reached.items():
            often[times].append(p)
        for at in reversed(often):  # most often first, as each new group goes right above the old one
            new: dict[int, int] = {}
            for p in at:
                old = group[p]
                if old not in new:
                    new[old] = len(members)
                    members.append([])
                    done.append(False)
            for old, g in new.items():
                below[g], above[g] = old, above[old]
                below[above[old]], above[old] = g, g
            for p in at:
                g = new[group[p]]
                members[g].append(p)
                group[p] = g
        here = below[here]
    free, g, at = {}, 0, 0  # next free place of each group
    while at < n:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out, taken = [-1] * n, [False] * n

    def emit(i: int) -> None:
        while i >= 0 and not taken[i]:
            out[free[group[i]]], taken[i] = i, True
            free[group[i]] += 1
            i = smaller[i]

    emit(n - 1)  # it stands before the empty suffix, the smallest of all
    for at in range(n):
        emit(out[at] - 1)
    return out


def _lows(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``a[first] .. a[last]``, each, from least values over powers of two."""
    span = last - first + 1
    level = np.frexp(span.astype(np.float32))[1] - 1
    out, k = np.empty(len(first), a.dtype), 0
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(a[first[at]], a[last[at] - (1 << k) + 1])
        if k >= level.max(initial=0):
            return out
        a = np.minimum(a[: -(1 << k)], a[1 << k :])
        k += 1


def ordered_columns(grid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column, last first: the rows whose string covers it, in the order of their suffixes from there, and
    how many symbols each of these shares with the one before it.

    Row r of ``grid`` holds a string in the columns ``lo[r]`` up to ``hi[r]``. The groups of a column are its symbols
    at first. Taking those of the column after it in order, every suffix reaches the one a column before, which
    leaves for a new group above its old one: a stable distribution by symbol does this for all groups at once.
    """
    order, same = np.zeros(0, np.int64), np.zeros(0, np.int16)
    ends, at = np.argsort(-hi, kind="stable"), 0
    for c in range(grid.shape[1] - 1, -1, -1):
        first = at
        while at < len(ends) and hi[ends[at]] == c + 1:
            at += 1
        stay = lo[order] <= c
        if at > first or not stay.all():
            p = np.flatnonzero(stay)
            kept = np.zeros(at - first + len(p), np.int16)  # a string's last symbol has the empty suffix after it
            if len(p) > 1:
                kept[at - first + 1 :] = _lows(same, p[:-1] + 1, p[1:])
            order, same = np.concatenate([ends[first:at], order[p]]), kept
        if not len(order):
            continue
        symbols = grid[order, c]
        dealt = np.argsort(symbols, kind="stable")  # a radix sort for symbols of 16 bits
        symbols = symbols[dealt]
        twins = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        longer = np.zeros(len(order), np.int16)
        if len(twins):
            longer[twins] = 1 + _lows(same, dealt[twins - 1] + 1, dealt[twins])
        order, same = order[dealt], longer
        yield c, order, same
