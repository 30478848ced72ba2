"""Plain Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def classes(ids, linked):
    """Smallest id reachable from each, by checking every pair."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = words((text or "").translate(_LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard_classes(rows, n, num, den):
    """{id: (size of the set, smallest id of its class)} of (id, text) rows."""
    sets = {i: shingles(t, n) for i, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and den * len(x & y) >= num * len(x | y)

    part = classes(list(sets), linked)
    return {i: (len(sets[i]), part[i]) for i in sets}


def stripped(rows, window):
    """{id: (words, words removed, kept text)} of (id, text) rows."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def edit_search(item, text):
    """Least edit distance of item to any part of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def cosine_links(rows, least):
    """{id: number of others with that cosine} and {id: class} of (id, vector) rows."""
    import numpy as np

    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in list(v)}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    links = defaultdict(set)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    ids = [i for i, _ in rows]
    return {i: len(links[i]) for i in ids}, classes(ids, lambda a, b: b in links[a])
