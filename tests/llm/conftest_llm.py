"""Brute-force versions that the tests compare with."""

import hashlib
import re
from collections import Counter

from conftest import by_id  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_words(texts, size):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts.items()}
    count = Counter(tuple(w[k : k + size]) for w in words.values() for k in range(len(w) - size + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def kept_bytes(texts, size):
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(t[k : k + size] for t in raw.values() for k in range(len(t) - size + 1))
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        last = 0
        for k in range(len(t) - size + 1):
            if count[t[k : k + size]] > 1:
                for q in range(max(k, last), k + size):
                    gone[q] = 1
                last = k + size
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def components_of(sets, percent=80):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
