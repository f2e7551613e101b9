"""Suffix arrays by linear grouping of suffixes along their Lyndon prefixes (Baier, 2016)."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """The order of the suffixes of ``text``, a sequence of integers; a suffix is less than those that it is a prefix of.

    Suffixes are grouped by their first symbol. From the highest group down, each suffix of a group points to the nearest
    one before it of a lower group; suffixes that the group points to leave theirs for new groups right above it, higher the more
    pointers they get, as their Lyndon prefixes grow by that many copies of the group's. Then suffixes are placed from the
    least on: each places the one before it and those along its pointers, at the front of their groups.
    """
    _, ranks = np.unique(text, return_inverse=True)
    ranks = np.append(ranks + 1, 0)  # the end is less than any symbol
    n = len(ranks)
    starts = np.concatenate([[0], np.cumsum(np.bincount(ranks))])
    group = starts[ranks].tolist()  # a suffix's group is named by where its members start
    order = np.argsort(ranks, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    members, place = order.tolist(), place.tolist()
    size = [0] * n
    for g, k in zip(starts[:-1].tolist(), np.bincount(ranks).tolist()):
        size[g] = k
    before = [-1] * n

    end = n
    while end > 0:
        own = group[members[end - 1]]
        hits: dict[int, int] = {}
        for i in sorted(members[own:end]) if end - own > 1 else (members[own],):
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            most = max(hits.values())
            levels = [list(hits)] if most == 1 else [[j for j, k in hits.items() if k == c] for c in sorted(set(hits.values()), reverse=True)]
            for moved in levels:
                for j in moved:  # to the end of its group
                    g = group[j]
                    size[g] -= 1
                    at, last = place[j], g + size[g]
                    other = members[last]
                    members[at], members[last] = other, j
                    place[other], place[j] = at, last
                for j, new in [(j, group[j] + size[group[j]]) for j in moved]:
                    group[j] = new
                    size[new] += 1
        end = own

    out = [0] * n
    front = list(range(n))
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return out[1:]
