"""Suffix arrays by linear grouping: Lyndon-prefix groups, then each group's order, with no renaming rounds."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of integers that end with a unique smallest one.

    First, groups of suffixes by first symbol, in order, are taken from the
    highest down. A taken group has its final Lyndon prefix. Each member's
    pointer goes to the nearest earlier suffix whose group is lower; suffixes
    so pointed at grow by that prefix once a pointer, so they move, more
    pointers higher, to new groups right above their old ones.

    Then, in ascending order of the suffixes placed so far, the suffix before
    a placed one, and the chain of its pointers, take the next free place of
    their groups.
    """
    n = len(s)
    members: list[list[int]] = []
    group = [0] * n
    number: dict[int, int] = {}
    for i, c in enumerate(s):
        g = number.get(c)
        if g is None:
            g = number[c] = len(members)
            members.append([])
        members[g].append(i)
        group[i] = g
    ranked = [number[c] for c in sorted(number)]
    below = [-1] * len(members)
    above = [-1] * len(members)
    for a, b in zip(ranked, ranked[1:]):
        below[b], above[a] = a, b
    pointer = [-1] * n
    taken = [False] * n
    g = ranked[-1]
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        for i in own:
            taken[i] = True
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_count[c]:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    members[new].append(j)
                    group[j] = new
        g = below[g]
    free = [0] * len(members)
    g, at = ranked[0], 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = pointer[j]
    return order


def repeated_windows(strings: list[bytes], size: int) -> list[list[int]]:
    """For each string, the starts of its ``size``-byte windows that start anywhere else too, in any of the strings."""
    k = len(strings)
    text: list[int] = []
    whose: list[tuple[int, int]] = []
    for i, x in enumerate(strings):
        whose.extend((i, p) for p in range(len(x)))
        whose.append((i, len(x)))
        text.extend(b + k + 1 for b in x)
        text.append(i + 1)
    text.append(0)
    out: list[list[int]] = [[] for _ in strings]
    last, marked = None, False
    for at in suffix_array(text):
        if at == len(text) - 1:
            continue
        i, p = whose[at]
        if p + size > len(strings[i]):
            continue
        if last is not None and strings[last[0]][last[1] : last[1] + size] == strings[i][p : p + size]:
            if not marked:
                out[last[0]].append(last[1])
            out[i].append(p)
            marked = True
        else:
            marked = False
        last = (i, p)
    return [sorted(x) for x in out]
