"""Suffix array by grouping (linear construction without recursive renaming).

Suffixes are grouped by their first symbol, then groups are worked off in descending
order. Each suffix of a group points to the previous suffix of a lower group; those
suffixes are moved, within their own group, into a higher group of their own, the ones
that are pointed at more often first. When all groups are done, each holds the suffixes
of one Lyndon prefix, and the array follows in one ascending sweep: a suffix that is
placed settles, along the same pointers, the next place of each group it follows.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` (integers, any range) in ascending order.

    A symbol smaller than all others is added as the end and left out of the result.
    """
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    ranks = np.zeros(n, dtype=np.int64)
    ranks[:-1] = np.unique(symbols, return_inverse=True)[1].reshape(-1) + 1
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]]))
    sizes = np.diff(np.append(first, n))
    begin = np.repeat(first, sizes)
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    group = np.empty(n, dtype=np.int64)
    group[order] = begin
    size = np.zeros(n, dtype=np.int64)
    size[first] = sizes
    return np.array(_sweep(*_lyndon_groups(order.tolist(), where.tolist(), group.tolist(), size.tolist()))[1:], dtype=np.int64)


def _lyndon_groups(held: list, where: list, group: list, size: list) -> tuple[list, list]:
    """Refines the groups; returns each suffix's group (the place of its first member) and its pointer."""
    before = [-1] * len(held)
    top = len(held) - 1
    while top > 0:
        start = group[held[top]]
        if start == top:  # one member
            s = held[top]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                _raise(p, held, where, group, size)
            top -= 1
            continue
        members = sorted(held[start : top + 1])
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[times]:
                g = group[p]
                k = moved.get(g, 0)
                moved[g] = k + 1
                _swap(p, g + size[g] - 1 - k, held, where)
            for g, k in moved.items():
                if k < size[g]:
                    fresh = g + size[g] - k
                    size[g] -= k
                    size[fresh] = k
                    for at in range(fresh, fresh + k):
                        group[held[at]] = fresh
        top = start - 1
    return group, before


def _swap(p: int, to: int, held: list, where: list) -> None:
    at = where[p]
    if at != to:
        other = held[to]
        held[at], held[to] = other, p
        where[other], where[p] = at, to


def _raise(p: int, held: list, where: list, group: list, size: list) -> None:
    """``p`` becomes a group of its own above the rest of its group."""
    g = group[p]
    rest = size[g] - 1
    if rest:
        to = g + rest
        _swap(p, to, held, where)
        size[g] = rest
        size[to] = 1
        group[p] = to


def _sweep(group: list, before: list) -> list:
    """Settles the order inside the groups, from the lowest suffix up."""
    n = len(group)
    free = list(range(n))  # next free place, by the group's first place
    out = [-1] * n
    settled = [False] * n
    out[0], settled[n - 1] = n - 1, True
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not settled[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            settled[s] = True
            s = before[s]
    return out
