"""Plain-Python versions of the training-text operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
from itertools import groupby

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Texts that every operator must take: null, empty, blank, repeated, tied and odd ones.
EDGES = [None, "", " ", "\n", "\n\n", "a", "A", "b a", "b  a", "Ää ß x", "12345", "!!!", "the cat\nthe cat", " x", "x" * 3000]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text) -> list of (doc_id, kept text, n_lines, n_dropped)."""
    rank = lambda d: (d is not None, d or 0)
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(WHITE).translate(FOLD)
            if len(key) >= min_chars:
                holders[key].add(doc)
    keeper = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := x.strip(WHITE).translate(FOLD)) not in keeper or keeper[k] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def near_dup(rows, n, percent=80):
    """rows: (doc_id, text), unique ids -> {doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """{source: size} -> {source: target}, resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full, left = share * sum(sizes.values()), {}, dict(weight)
    while left:
        rest = goal - sum(full.values())
        part = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if part[s] > cap * sizes[s]]
        if not over:
            return {**full, **part}
        for s in over:
            full[s] = float(cap * sizes[s])
            del left[s]
    return full


def discounts(counts):
    n1, n2, n3, n4 = (sum(v == i for v in counts.values()) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw))


class KneserNey:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        self.raw = collections.Counter()
        top = collections.Counter()
        for t in texts:
            line = ["<s>"] * (order - 1) + words(t) + ["</s>"]
            self.raw.update(line[order - 1 :])
            top.update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            lower = collections.Counter()
            for gram, c in self.counts[k + 1].items():
                lower[gram[1:]] += c if gram[1] == "<s>" else 1
            self.counts[k] = lower
        self.d = {k: discounts(c) for k, c in self.counts.items()}
        self.context = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in self.counts}
        for k, c in self.counts.items():
            for gram, n in c.items():
                cell = self.context[k][gram[:-1]]
                cell[0] += n
                cell[min(n, 3)] += 1

    def p(self, gram, k=None):
        k = k or self.order
        low = 1 / (len(self.raw) + 1) if k == 1 else self.p(gram[1:], k - 1)
        cell = self.context[k].get(gram[:-1])
        if not cell:
            return low
        n = self.counts[k].get(gram, 0)
        high = max(n - (0, *self.d[k])[min(n, 3)], 0) / cell[0]
        return high + sum(d * m for d, m in zip(self.d[k], cell[1:])) / cell[0] * low

    def score(self, text):
        line = ["<s>"] * (self.order - 1) + words(text) + ["</s>"]
        return sum(math.log10(self.p(tuple(line[i : i + self.order]))) for i in range(len(line) - self.order + 1))

    def base(self, text):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[w] + 1) / (n + v + 1)) for w in [*words(text), "</s>"])


def generalised_jaccard(a, b):
    x, y = collections.Counter(words(a)), collections.Counter(words(b))
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def feistel(left, right, sizes, key, kind, tweak, rounds=8):
    for i in range(rounds):
        seen = right if i % 2 == 0 else left
        drawn = int(hashlib.sha256(f"{key}|{kind}|{tweak}|{i}|{seen}".encode()).hexdigest()[:13], 16)
        if i % 2 == 0:
            left = (left + drawn) % sizes[0]
        else:
            right = (right + drawn) % sizes[1]
    return left, right


def top_k(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in vectors if i != q and len(c) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def rows_by(rows, key):
    return {k: list(g) for k, g in groupby(sorted(rows, key=key), key)}
