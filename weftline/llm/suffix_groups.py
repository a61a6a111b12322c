"""Suffix arrays by linear grouping.

Phase 1 puts suffixes in groups by their longest Lyndon prefix. It starts with groups of equal first symbols and goes
through the groups from the highest to the lowest. For each suffix of the group it finds the previous smaller one: the
nearest suffix to the left that lies in a lower group. A suffix that n members point to has its prefix continued by n
repetitions of the group's prefix, so it moves to a new group directly above what is left of its own; more repetitions
go higher. Phase 2 goes through the suffix array from its start: a suffix at hand settles the one before it, and the
chain of previous smaller pointers from there, each at the next free place of its group. No symbol is ever renamed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers in order; a suffix that is a prefix of another comes first."""
    text = np.append(np.asarray(symbols, np.int64), np.int64(-1) if not len(symbols) else np.min(symbols) - 1)
    n = len(text)
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(text[order]) > 0, [True]]))
    place = order.tolist()  # suffixes in the order of their groups
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    at = at.tolist()  # where a suffix stands in `place`
    starts = np.repeat(cuts[:-1], np.diff(cuts))
    group = np.empty(n, np.int64)
    group[order] = starts
    group = group.tolist()  # the group of a suffix, named by its first place
    end = [0] * n  # one past a group's last place
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        end[a] = b
    previous = [-1] * n

    high = n
    while high:
        low = group[place[high - 1]]
        members = place[low:high]
        if high - low > 1:
            members.sort()  # then those further left know their pointers
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for j, count in pointed.items():
                by_count.setdefault(count, []).append(j)
            for count in sorted(by_count, reverse=True):
                was: dict[int, int] = {}
                for j in by_count[count]:
                    g = group[j]
                    was.setdefault(g, end[g])
                    last = end[g] - 1
                    k, other = at[j], place[last]
                    place[k], place[last] = other, j
                    at[other], at[j] = k, last
                    end[g] = last
                for g, upper in was.items():
                    fresh = end[g]
                    if fresh > g:
                        for k in range(fresh, upper):
                            group[place[k]] = fresh
                    end[fresh] = upper
        high = low

    free = [-1] * n
    out = [0] * n
    done = [False] * n
    out[0], done[n - 1] = n - 1, True
    for rank in range(n):
        j = out[rank] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            k = free[g] if free[g] >= 0 else g
            out[k], done[j], free[g] = j, True, k + 1
            j = previous[j]
    return np.array(out[1:], np.int64)
