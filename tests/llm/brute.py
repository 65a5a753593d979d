"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_dup(docs, k, percent):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, t in docs:
        w = words(ascii_lower(t))
        m = min(k, len(w))
        sets[i] = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    pairs = {(a, b) for ids in inverted.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring_dedup(docs, n=20):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        drop = [False] * len(w)
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            if x in seen:
                drop[j : j + n] = [True] * n
            seen.add(x)
        kept = [a for a, d in zip(w, drop) if not d]
        out[i] = (len(w), sum(drop), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
