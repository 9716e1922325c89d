"""Plain versions of the operators, for tables of a few hundred rows."""

import hashlib
import itertools
import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SEPARATORS = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text, pattern=SPACE):
    return [w for w in pattern.split(text or "") if w]


def shingle_set(text, size=5):
    w = split(lower(text))
    if not w:
        return set()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def near_duplicates(rows, percent=75):
    """{id: (n_shingles, component)} of (id, text) rows with different ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated_windows(rows, window=13):
    """{id: (n_words, n_removed, kept text)}."""
    found = {i: split(t) for i, t in sorted(rows, key=lambda r: r[0])}
    first, out = {}, {}
    for i, w in found.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k:k + window]), i) < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def contamination(rows, items, window=13):
    """{id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = split(lower(text), SEPARATORS)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add(str(item))
    lengths, out = sorted({len(x) for x in windows}), {}
    for i, text in rows:
        w = split(lower(text), SEPARATORS)
        hit, names = [0] * len(w), set()
        for k in range(len(w)):
            for n in lengths:
                found = windows.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if found:
                    names |= found
                    hit[k:k + n] = [1] * n
        n = sum(hit)
        out[i] = (len(w), n, len(names), sha(",".join(sorted(names))), n > 0 and 20 * n >= len(w))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
