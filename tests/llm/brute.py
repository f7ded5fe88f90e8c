"""Plain versions of the operators, for small tables."""

from collections import defaultdict


def shingles(text, words):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    parts = [w for w in text.split(" ") if w]
    if not parts:
        return frozenset()
    if len(parts) < words:
        return frozenset([tuple(parts)])
    return frozenset(tuple(parts[i : i + words]) for i in range(len(parts) - words + 1))


def near_duplicates(rows, words, percent):
    """(key, set size, component, kept) of each (key, text)."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                common[j] += 1
            where[x].append(i)
        for j, n in common.items():
            if n * 100 >= percent * (len(s) + len(sets[j]) - n) and rows[i][0] is not None and rows[j][0] is not None:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [
        (k, len(s), None if k is None else low[find(i)], k is None or low[find(i)] == k)
        for i, ((k, _), s) in enumerate(zip(rows, sets))
    ]
