"""Brute-force versions of what operators compute."""

import hashlib

import numpy as np


def brute_repeats(rows, n=50):
    """doc -> sorted (bytes, removed, spans, digest) by looking at every string of n bytes."""
    rows = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in rows:
        for p in range(len(t) - n + 1):
            k = t[p : p + n]
            first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), np.int8)
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < i:
                gone[p : p + n] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[gone == 0])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_components(ids, fps, radius=3):
    """Smallest id reachable over fingerprints that differ in at most radius bits."""
    fps, parent = np.array(fps, np.uint64), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, doc in enumerate(ids):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return [low[root(i)] for i in range(len(ids))]


def brute_near_copies(ids, texts, n=5):
    """Smallest id reachable over pairs whose sets of n-word shingles have a similarity of 4/5 or more."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, doc in enumerate(ids):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return [low[root(i)] for i in range(len(ids))]


def brute_windows(rows, n=50):
    """(doc, words, removed, digest) by looking at every window of n words."""
    rows = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in rows:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)
