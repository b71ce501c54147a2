"""Plain Python versions that the operators are compared with."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width=5):
    w = words(text)
    if not w:
        return set()
    width = min(width, len(w))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def jaccard_components(rows):
    """[(doc_id, text)] -> sorted [(doc_id, n_shingles, component_id)]."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))
