"""Context-tree weighting over bytes, in NumPy.

A text is its lower-cased words, one space between them, and an end byte; a byte
is eight binary decisions, the most significant bit first, each with a tree of
contexts of its own (the preceding 0 to ``depth`` bytes). Every context node
estimates a bit by Krichevsky-Trofimov counts, and the weighted probability of a
node is the mean of its own estimate and the product of its children's, so each
prediction mixes all depths by how well they coded the training bytes.

Every context that occurs is a node. ``Subtrees`` and ``top`` hold the tree in
parts, so that it may be of any size: below each context of two bytes only the
bit nodes that occur, above them two levels. ``build`` makes a tree of given
nodes in one piece; what a node's children leave over is then one more child,
*the rest*, so no byte goes uncounted and the tree is a proper one. Scoring uses
the counts as they are after training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from siltseek.llm import bytescan

END = 0x0A


def streams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each document as words, single spaces and the end byte."""
    n = len(offsets) - 1
    raw = np.full(len(data) + n, END, np.uint8)
    end_at = offsets[1:] + np.arange(n)
    is_end = np.zeros(len(raw), bool)
    is_end[end_at] = True
    raw[~is_end] = bytescan.LOWER[data]
    space = bytescan.SPACE[raw] & ~is_end
    word = ~space & ~is_end
    keep = word | is_end
    keep[:-1] |= space[:-1] & word[1:]
    first = offsets[:-1] + np.arange(n)
    lead = np.flatnonzero(space[first]) if len(raw) else []
    if len(lead):  # the blank before a document's first word separates nothing
        at = np.flatnonzero(word)
        after = np.searchsorted(at, first[lead])
        known = after < len(at)
        start = at[after[known]]
        keep[start[start < end_at[lead[known]]] - 1] = False
    raw[space] = 0x20
    counts = np.add.reduceat(keep, first, dtype=np.int64) if n else np.zeros(0, np.int64)
    return raw[keep], np.concatenate([[0], np.cumsum(counts)])


def preceding(stream: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """The byte ``back`` places before each one; before a document's start, the end byte."""
    out = np.empty_like(stream)
    out[back:] = stream[: len(stream) - back]
    for t in range(back):
        at = offsets[:-1] + t
        out[at[at < offsets[1:]]] = END
    return out


def grams(stream: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, byte) grams and their counts."""
    key = keys(stream, offsets, depth)
    key.sort()
    return summed(key, np.ones(len(key), np.int64))


def keys(stream: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The (context, byte) gram of each byte; the byte is the low one."""
    key = stream.astype(np.uint64)
    for j in range(1, depth + 1):
        key |= preceding(stream, offsets, j).astype(np.uint64) << np.uint64(8 * j)
    return key


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up over equal, sorted keys."""
    if not len(key):
        return key, n
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(n, at)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted up by eight to be exact to 1e-12."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def _bit_counts(symbols: np.ndarray) -> np.ndarray:
    """Counts of 256 bytes to counts of the 512 nodes of the bit tree (heap order)."""
    out = np.zeros((len(symbols), 512))
    out[:, 256:] = symbols
    for v in (128, 64, 32, 16, 8, 4, 2, 1):
        out[:, v : 2 * v] = out[:, 2 * v : 4 * v : 2] + out[:, 2 * v + 1 : 4 * v : 2]
    return out


def _estimates(symbols: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(log of the KT block probability, probability that the next bit is 1) by bit node."""
    if len(symbols) > rows:  # a slice at a time, for memory
        log_block, p = np.empty((len(symbols), 256)), np.empty((len(symbols), 256), np.float32)
        for i in range(0, len(symbols), rows):
            log_block[i : i + rows], p[i : i + rows] = _estimates(symbols[i : i + rows], rows)
        return log_block, p
    counts = _bit_counts(symbols)
    a, b = counts[:, 0:512:2][:, :256], counts[:, 1:512:2][:, :256]  # children 2v and 2v + 1 of node v
    log_block = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return log_block, (b + 0.5) / (a + b + 1)


def _byte_costs(bit: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from P(1) at each bit node."""
    p = np.clip(bit.astype(np.float64), 1e-12, 1 - 1e-12)
    total = np.zeros((len(p), 1))
    for level in range(8):  # nodes 2^level to 2^(level + 1) - 1 are this level's
        one = p[:, 1 << level : 2 << level]
        total = np.stack([total + np.log10(1 - one), total + np.log10(one)], axis=2).reshape(len(p), -1)
    return total


@dataclass
class Tree:
    """``step[state, byte]`` walks back from a byte; ``cost[state, byte]`` is its log10 probability."""

    depth: int
    step: np.ndarray
    cost: np.ndarray

    def score(self, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log10 probability of each document of a stream."""
        state = np.zeros(len(stream), np.int64)
        flat, cost = self.step.reshape(-1), self.cost.reshape(-1)
        for j in range(1, self.depth + 1):
            state = flat[(state << 8) + preceding(stream, offsets, j)].astype(np.int64)
        value = cost[(state << 8) + stream].astype(np.float64)
        return np.add.reduceat(value, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)


def build(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Tree:
    """The tree from, for each depth 0, 1, ..., the kept (context, byte, count) arrays.

    Contexts are integers whose low byte is the latest one; a context's parent
    must be kept too. Rows of a level are sorted by (context, byte).
    """
    depth = len(levels) - 1
    contexts, symbols = [], []
    for d, (context, byte, n) in enumerate(levels):
        one, at = np.unique(context, return_inverse=True)
        if d == 0 and not len(one):
            one = np.zeros(1, np.uint64)
        table = np.zeros((len(one), 256))
        table[at, byte] = n
        contexts.append(one)
        symbols.append(table)
    parent = [None] + [np.searchsorted(contexts[d - 1], contexts[d] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]
    # upwards: the weight of a node's own estimate against its children's
    own, ones, rest_ones = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
    below = None
    for d in range(depth, -1, -1):
        log_own, p = _estimates(symbols[d])
        ones[d] = p.astype(np.float32)
        if d == depth:
            weighted = log_own
        else:
            rest = symbols[d].copy()
            np.subtract.at(rest, parent[d + 1], symbols[d + 1])
            log_rest, p_rest = _estimates(rest)
            rest_ones[d] = p_rest.astype(np.float32)
            children = log_rest
            np.add.at(children, parent[d + 1], below)
            own[d] = (1 / (1 + np.exp(np.clip(children - log_own, -700, 700)))).astype(np.float32)
            weighted = np.logaddexp(log_own, children) - np.log(2)
        below = weighted
    # downwards: what all shallower nodes say, and the weight left for deeper ones
    start = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    step = np.empty((start[-1], 256), np.uint16 if start[-1] <= 1 << 16 else np.int32)
    cost = np.empty((start[-1], 256), np.float32)
    said, left = np.zeros((1, 256), np.float32), np.ones((1, 256), np.float32)
    for d in range(depth + 1):
        if d:
            said, left = said[parent[d]], left[parent[d]]
        here = slice(start[d], start[d + 1])
        if d == depth:
            bit = said + left * ones[d]
        else:
            said = said + left * own[d] * ones[d]
            left = left * (1 - own[d])
            bit = said + left * rest_ones[d]
        for i in range(0, len(bit), 1024):
            cost[start[d] + i : start[d] + min(i + 1024, len(bit))] = _byte_costs(bit[i : i + 1024])
        # a state that has no child for a byte stays itself: its rest child predicts
        step[here] = np.arange(start[d], start[d + 1])[:, None]
        if d:
            oldest = (contexts[d] >> np.uint64(8 * (d - 1))).astype(np.int64)
            step[start[d - 1] + parent[d], oldest] = np.arange(start[d], start[d + 1])
    return Tree(depth, step, cost)


#: (said, left) by last byte and bit node: what the contexts of no and one byte say, and the weight left for deeper ones.
Top = tuple[np.ndarray, np.ndarray]


def top(symbols: np.ndarray, below: np.ndarray) -> Top:
    """The two upper levels, from each last byte's counts and its children's summed log probabilities."""
    log_one, p_one = _estimates(symbols)
    log_none, p_none = _estimates(symbols.sum(0, keepdims=True))
    own_one = 1 / (1 + np.exp(np.clip(below - log_one, -700, 700)))
    children = (np.logaddexp(log_one, below) - np.log(2)).sum(0, keepdims=True)
    own_none = 1 / (1 + np.exp(np.clip(children - log_none, -700, 700)))
    left = 1 - own_none
    return own_none * p_none + left * own_one * p_one, left * (1 - own_one)


_FEW = 4096
_LOG_GAMMA = _log_gamma(np.arange(2 * _FEW) / 2 + 0.5)  # of 0.5, 1, 1.5, ...


def _log_gamma_of(n: np.ndarray, halves: int) -> np.ndarray:
    """log gamma of whole numbers ``n`` plus ``halves`` / 2, which is 1 or 2; small ones from a table."""
    out = _LOG_GAMMA[2 * np.minimum(n, _FEW - 1) + halves - 1]
    many = np.flatnonzero(n >= _FEW)
    out[many] = _log_gamma(n[many] + halves / 2)
    return out


class Subtrees:
    """The nodes of two to ``depth`` bytes over some grams, bit by bit, only where grams are.

    Grams are distinct and sorted; of a context of two bytes all that occur must
    be given. Grams of no occurrences may be among them: they change nothing.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int) -> None:
        turned = np.zeros_like(key)  # the context's latest byte first, then the older ones, then the byte
        for j in range(1, depth + 1):
            turned |= ((key >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8 * (depth + 1 - j))
        turned |= key & np.uint64(255)
        self.keys, self.counts, self.place = [], [], []  # from ``depth`` up to 2; ``place`` of the deeper level's grams among these
        for _ in range(depth, 1, -1):
            one, at = np.unique(turned, return_inverse=True)
            self.keys.append(one)
            self.counts.append(np.bincount(at, n, len(one)).astype(np.int64))
            self.place.append(at)
            turned, n = ((one >> np.uint64(16)) << np.uint64(8)) | (one & np.uint64(255)), self.counts[-1]

    def _level(self, bit: int) -> list[tuple[np.ndarray, ...]]:
        """For each depth, the deepest first: (first gram of each node, node of each gram, log probability
        of all below, own weight, probability of a 1), of the nodes of a byte's first ``bit`` bits."""
        out, below = [], None
        for i, (key, n) in enumerate(zip(self.keys, self.counts)):
            prefix = key >> np.uint64(8 - bit)
            new = np.append(True, prefix[1:] != prefix[:-1])
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            ones = np.add.reduceat(np.where((key >> np.uint64(7 - bit)) & np.uint64(1), n, 0), first)
            total = np.add.reduceat(n, first)
            log_own = _log_gamma_of(total - ones, 1) + _log_gamma_of(ones, 1) - _log_gamma_of(total, 2) - np.log(np.pi)
            if i == 0:
                weighted, own = log_own, np.ones(len(first))
            else:
                children = np.bincount(node[self.place[i][out[-1][0]]], below, len(first))
                own = 1 / (1 + np.exp(np.clip(children - log_own, -700, 700)))
                weighted = np.logaddexp(log_own, children) - np.log(2)
            below = weighted
            out.append((first, node, weighted, own, (ones + 0.5) / (total + 1)))
        return out

    def _parent(self, first: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(last byte, bit node) above each node of two bytes, from its first gram."""
        key = self.keys[-1][first]
        return (key >> np.uint64(16)).astype(np.int64), (1 << bit) | ((key & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last byte, counts of the 256 bytes, log probabilities by bit node), summed over the contexts of two bytes."""
        key = self.keys[-1]
        symbols, below = np.zeros((256, 256)), np.zeros((256, 256))
        np.add.at(symbols, ((key >> np.uint64(16)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)), self.counts[-1])
        for bit in range(8):
            first, _, weighted, _, _ = self._level(bit)[-1]
            np.add.at(below, self._parent(first, bit), weighted)
        last = np.flatnonzero(symbols.any(1))
        return last, symbols[last], below[last]

    def costs(self, above: Top) -> np.ndarray:
        """The log10 probability of each gram's byte after its context, in the order given."""
        cost = np.zeros(len(self.keys[0]))
        for bit in range(8):
            levels = self._level(bit)
            parent = self._parent(levels[-1][0], bit)
            said, left = above[0][parent], above[1][parent]
            for i in range(len(levels) - 1, -1, -1):
                first, node, _, own, p = levels[i]
                said, left = said + left * own * p, left * (1 - own)
                if i:
                    up = node[self.place[i][levels[i - 1][0]]]
                    said, left = said[up], left[up]
            one = ((self.keys[0] >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            p = np.clip(said, 1e-12, 1 - 1e-12)[levels[0][1]]
            cost += np.log10(np.where(one, p, 1 - p))
        return cost[self.place[0]]
