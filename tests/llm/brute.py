"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import lgamma, log, pi

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingle_set(text, size):
    w = words(text)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_components(rows, size, percent):
    """(n_shingles, smallest id of the component) by position of (id, text) rows."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (id_, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), 1 << 63), (1 << 63) - 1 if id_ is None else id_)
    return [(len(sets[i]), smallest[find(i)]) for i in range(len(rows))]


def removed_windows(rows, width=100):
    """id -> (n_bytes, n_removed, n_spans, sha256 of what is left); rows in id order."""
    seen, out = set(), {}
    for id_, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[id_] = (len(data), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def unigram_scores(rows, folds=7, fold=2):
    """id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = {i: zlib.crc32(str(i).encode()) % folds == fold for i, _ in rows}
    tokens = {i: [*words(t), None] for i, t in rows}
    c = Counter(x for i, _ in rows if not held[i] for x in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ts), sum(c[x] > 0 for x in ts), n, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for i, ts in tokens.items()}


def tree_scores(rows, depth, folds=7, fold=2):
    """id -> log10 probability by context-tree weighting over the bits of words, single spaces and an end byte."""
    streams = {i: b" ".join(words(t)) + b"\n" for i, t in rows}
    counts = Counter()  # (context bytes, the latest first; bits of the byte so far; bit)
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % folds != fold:
            for past, bits in steps(streams[i], depth):
                for d in range(depth + 1):
                    for k in range(8):
                        counts[past[:d], bits[:k], bits[k]] += 1
    children = {}
    for past, bits, _ in counts:
        if past:
            children.setdefault((past[:-1], bits), set()).add(past)
    own, weighted, share = {}, {}, {}

    def weigh(past, bits):
        """log of the weighted probability of a node's training bits."""
        if (past, bits) not in weighted:
            a, b = (counts[past, bits, x] for x in "01")
            block = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
            own[past, bits] = (b + 0.5) / (a + b + 1)
            if len(past) == depth:
                weighted[past, bits], share[past, bits] = block, 1.0
            else:
                below = sum(weigh(c, bits) for c in children.get((past, bits), ()))
                weighted[past, bits] = np.logaddexp(block, below) - log(2)
                share[past, bits] = 1 / (1 + np.exp(below - block))
        return weighted[past, bits]

    def one(past, bits):
        p, left = 0.0, 1.0
        for d in range(depth + 1):
            weigh(past[:d], bits)
            p += left * share[past[:d], bits] * own[past[:d], bits]
            left *= 1 - share[past[:d], bits]
        return p

    return {i: sum(np.log10(one(past, bits[:k]) if bits[k] == "1" else 1 - one(past, bits[:k])) for past, bits in steps(streams[i], depth) for k in range(8)) for i, _ in rows}


def steps(stream, depth):
    """(preceding bytes, the latest first; bits) of each byte; before the start stand end bytes."""
    padded = b"\n" * depth + stream
    return [(padded[j : j + depth][::-1], f"{stream[j]:08b}") for j in range(len(stream))]


def contaminated(rows, items, size=5):
    """(id, item) pairs by whole passages of twice the longest item's words."""
    part = re.compile(rb"(?:[a-z0-9]|[\x80-\xff])+")
    cut = lambda t: part.findall((t or "").encode().translate(LOWER))
    tests = [(i, w) for i, w in ((i, cut(t)) for i, t in items) if w]
    stride = max((len(w) for _, w in tests), default=1)
    found = set()
    for id_, text in rows:
        w = cut(text)
        for start in range(0, max(len(w), 1), stride):
            passage = w[start : start + 2 * stride]
            for item, own in tests:
                k = min(size, len(own))
                there = {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}
                hit = [tuple(own[i : i + k]) in there for i in range(len(own) - k + 1)]
                half = -(-len(hit) // 2)
                if 10 * sum(hit) >= 8 * len(hit) and 2 * sum(hit[:half]) >= half and 2 * sum(hit[half:]) >= len(hit) - half:
                    found.add((id_, item))
    return found
