"""Plain-Python versions of the corpus operators."""

import hashlib
import re

import numpy as np
import xxhash

from demandgrid.llm import pii

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, fps, distance=3):
    """Smallest id (None last) reachable over links, per row."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance):
            parent[find(i)] = find(int(i + 1 + j))
    least = {}
    for i, d in zip(range(len(a)), ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[find(i)] for i in range(len(a))]


def near_classes(rows, percent=80, width=5):
    """Smallest id (None last) reachable over pairs of similar shingle sets, per row."""
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if root[i] != root[k] and (sets[i] == sets[k] or 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]) > 0):
                root = [root[k] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[r] for r in root]


def strip_repeats(rows, span=50):
    """[(n_words, n_removed, kept_sha256)] for (doc_id, text) rows."""
    first = {}
    split = [WORDS.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        if d is not None:
            for i in range(len(w) - span + 1):
                k = tuple(w[i : i + span])
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if d is not None and first.get(tuple(w[i : i + span]), d) < d:
                gone[i : i + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def line_removals(rows, percent=80):
    """{doc_id: set of removed line numbers}; equal (doc_id, line) pairs count once."""
    lines = sorted({(d, k, frozenset(WORDS.findall(x))) for d, t in rows if d is not None for k, x in enumerate((t or "").split("\n")) if WORDS.search(x)}, key=lambda x: (x[0], x[1], sorted(x[2])))
    out = {}
    for i, (d, k, s) in enumerate(lines):
        for e, m, r in lines[:i]:
            if (e, m) != (d, k) and 100 * len(s & r) >= percent * len(s | r):
                out.setdefault(d, set()).add(k)
                break
    return out


def unseen_identifiers(rows, rounds=3, min_seeds=5, confident=0.7, accept=0.9, prior=2.0):
    """Texts of the identifiers that contexts reveal, by plain dicts over (doc_id, text) rows:
    {(kind, lower-case text)}.  Slots and kinds come from the operator's own helpers."""
    def plain(word):
        return re.sub("[0-9]", "0", word.strip(pii.TRIM).lower()) if len(word) <= pii.LONGEST else ""

    edges, fillers = {}, {}
    for _, text in rows:
        text = text or ""
        spans = pii.base_spans(text)
        covered = sorted((s, e) for _, s, e in spans)
        found = [(k, s, e, True) for k, s, e in spans]
        for place in pii.slots(text, covered):
            s, e = pii._trimmed(text, *place)
            if pii.likely_kind(text[s:e]) is not None:
                found.append((pii.likely_kind(text[s:e]), s, e, False))
        for kind, s, e, seed in found:
            left, right = [plain(w) for w in WORDS.findall(text[:s])[-2:]], [plain(w) for w in WORDS.findall(text[e:])[:1]]
            value = (kind, text[s:e].lower())
            patterns = [("L", *left)] if len(left) == 2 else []
            patterns += [("B", left[-1], right[0])] if left and right else []
            for p in (p for p in patterns if any(p[1:])):
                at = edges.setdefault((p, kind), {})
                at[value] = at.get(value, False) or seed
        words = WORDS.findall(text)
        for i, w in enumerate(words):
            if not re.search("[0-9@]", w):
                if i >= 2:
                    fillers.setdefault(("L", plain(words[i - 2]), plain(words[i - 1])), set()).add(plain(w))
                if 1 <= i < len(words) - 1:
                    fillers.setdefault(("B", plain(words[i - 1]), plain(words[i + 1])), set()).add(plain(w))
    seeds = {v for at in edges.values() for v, seed in at.items() if seed}
    every = {v for at in edges.values() for v in at}
    share = [sum(v[0] == k for v in seeds) / (sum(v[0] == k for v in every) + 1) for k in range(4)]
    sure = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        doubt = {}
        for (p, kind), at in edges.items():
            n = sum(sure.get(v, 0) >= accept for v in at)
            others = sum(seed for (q, k), vs in edges.items() if q == p and k != kind for seed in vs.values())
            trust = min(round((n + prior * share[kind]) / (n + len(fillers.get(p, ())) + others + prior), 9), 0.999999)
            if n >= min_seeds and 2 * n >= len(at) and trust >= confident:
                for v in at:
                    doubt[v] = doubt.get(v, 1.0) * (1 - trust)
        sure = {v: round(1 - d, 9) for v, d in doubt.items()} | dict.fromkeys(seeds, 1.0)
    return {v for v, x in sure.items() if x >= accept} - seeds
