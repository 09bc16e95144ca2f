"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import regex

SPACES = b" \t\n\x0b\f\r"


def words(text):
    return (text or "").encode().split()


def lines(rows, least=20, docs=3):
    """[(doc_id, n_lines, n_dropped, kept)] of (doc_id, text) rows; every row is a document."""
    key = lambda line: line.strip(SPACES).lower()
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").encode().split(b"\n")}:
            if len(k.decode()) >= least:
                holders[k].append(i)
    last = {k: max(h, key=lambda i: (i is not None, i or 0)) for k, h in holders.items() if len(h) >= docs}
    out = []
    for i, t in rows:
        parts = (t or "").encode().split(b"\n")
        kept = [x for x in parts if key(x) not in last or last[key(x)] == i]
        out.append((i, len(parts), len(parts) - len(kept), b"\n".join(kept)))
    return out


def components(rows, n=4, percent=85):
    """{doc_id: (size, smallest linked doc_id)} of (doc_id, text) rows with distinct doc_ids."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, window, units):
    """{doc_id: (units, gone flags)}: units covered by a window that starts earlier too."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        u = units(t)
        gone = bytearray(len(u))
        for k in range(len(u) - window + 1):
            x = u[k : k + window]
            x = x if isinstance(x, bytes) else tuple(x)
            if x in seen:
                gone[k : k + window] = b"\1" * window
            else:
                seen.add(x)
        out[i] = (u, gone)
    return out


def kept_words(rows, window=20):
    return {i: (len(u), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(u, g, strict=True) if not x)).hexdigest()) for i, (u, g) in repeats(rows, window, words).items()}


def kept_bytes(rows, window=100):
    out = {}
    for i, (u, g) in repeats(rows, window, lambda t: (t or "").encode()).items():
        spans = sum(1 for k, x in enumerate(g) if x and not (k and g[k - 1]))
        out[i] = (len(u), sum(g), spans, hashlib.sha256(bytes(c for c, x in zip(u, g, strict=True) if not x)).hexdigest())
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} of {source: size}, by repeated sharing of what goes over the caps."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def top(vectors, k=5):
    """{query: [(rank, vec_id, score)]} of {vec_id: ints}; queries are the ids divisible by 50."""
    out = {}
    for q in (i for i in vectors if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def word_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def counts(items):
    return Counter(items)


def spots(text, anchors, chain):
    """The set of (anchor, content words that follow); without anchors a chain starts at every word."""
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    common = set(anchors)
    if not any(x in common for x in w):
        return {(x, *w[k + 1 : k + 1 + chain]) for k, x in enumerate(w)}
    return {(x, *[y for y in w[k + 1 :] if y not in common][:chain]) for k, x in enumerate(w) if x in common}
