"""Plain Python versions to hold the operators against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(lower_az(text or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_groups(rows):
    """{row number: smallest id of the component} over (id, text) rows, all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    places = {}
    for i, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(i)
    common = {}
    for held in places.values():
        for k, i in enumerate(held):
            for j in held[:k]:
                common[i, j] = common.get((i, j), 0) + 1
    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        r = root(i)
        least[r] = name if r not in least else min(least[r], name)
    return {i: least[root(i)] for i in range(len(rows))}
