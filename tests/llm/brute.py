"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return t.translate({c: c + 32 for c in range(65, 91)})


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def repeated_spans(docs, k=20):
    """docs: (doc_id, text). -> {doc_id: (n_words, n_removed, sha)}"""
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (d, i):
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def contamination(docs, bench, n=10):
    grams = defaultdict(set)
    for item, t in bench:
        w = ALNUM.findall(lower(t or ""))
        for i in range(max(1, len(w) - n + 1)):
            if w:
                grams[tuple(w[i : i + n])].add(item)
    lengths = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, items = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    items |= grams[g]
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return sorted(out)


def components(ids, links):
    to = {i: i for i in ids}

    def root(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_sets(docs, k=3):
    out = []
    for d, t in docs:
        w = SPACED.findall(lower(t or ""))
        out.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def shingle_components(docs, k=3, num=90, den=100):
    sets = shingle_sets(docs, k)
    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(i)
    links = set()
    for i, (d, s) in enumerate(sets):
        count = defaultdict(int)
        for g in s:
            for j in at[g]:
                if j < i:
                    count[j] += 1
        for j, n in count.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                links.add((sets[j][0], d))
    c = components([d for d, _ in sets], links)
    return sorted((d, len(s), c[d]) for d, s in sets)
