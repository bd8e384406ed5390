"""MinHash near-dedup with tensored banding, every link verified on full sets.

A document's set is its distinct word shingles. m left and m right sketches of
``ROWS`` minhashes each make m^2 table keys (left i with right j), so the tables
need 2 m ROWS minhashes instead of 2 m^2 ROWS. A pair at similarity s meets
unless all left or all right sketches differ, which 2 (1 - s^ROWS)^m bounds: with
m = 10 at s = 0.85 a loss of 1.5e-4, at 0.9 of 4e-6 per pair.

1. Texts become (set size, set digest, sketches, signature); equal sets are one
   *node*. The signature is two bits of each of 64 minhashes.
2. Of nodes that share a table key the smallest leads, and is compared with all
   of them by signature; what agrees firmly follows it, and as long as some
   follow none, the next one leads. Meetings that agree too little are dropped,
   and doubtful ones are verified on full sets. What is left closes to
   *candidate groups*: documents that share no more than boilerplate don't meet
   in one, however many they are.
3. A group of bounded size is clustered in one task by exact intersections of
   all its sets. In a larger group each met (leader, node) pair is verified
   first, which links nearly all; the nodes left outside the group's main cluster
   are then compared, in blocks, with every node of the group. No pair is emitted
   but links that hold.

Full sets are sets of 64-bit shingle hashes, and equal sets are told by two
64-bit sums over them and their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan
from siltseek.llm.components import components, dealt, forest
from siltseek.llm.scratch import drop_rows, scratch, spread_join

ROWS = 3
#: The likeliest loss of a pair just at the threshold; it sets the number of sketches.
LOSS = 2e-4
#: A group is clustered in one task up to so many nodes and shingles.
GROUP_NODES, GROUP_SHINGLES = 1000, 800_000
#: In larger groups so many nodes outside the main cluster (or shingles of theirs) meet so many others at a time.
BLOCK_NODES, BLOCK_SHINGLES, PART_NODES, PART_SHINGLES = 256, 200_000, 1024, 400_000
_LAST = (1 << 63) - 1
_ODD = np.random.default_rng(7).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the shingles of each document of a block, in order, with repeats.

    Words are lower-cased (A-Z); a document with fewer than ``size`` words, but
    one at least, has its whole word sequence as one shingle.
    """
    data = bytescan.LOWER[data]
    start, end, doc = bytescan.words(data, offsets)
    n_docs = len(offsets) - 1
    hashes = bytescan.Sums(data).hashes(start, end)
    n_words = np.bincount(doc, minlength=n_docs)
    n = max(0, len(hashes) - size + 1)
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x += hashes[j : j + n] * _ODD[j]
    whole = doc[:n] == doc[size - 1 : size - 1 + n] if n else np.zeros(0, bool)
    x, owner = x[whole], doc[:n][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        first = np.cumsum(n_words) - n_words
        extra = np.array([(hashes[first[d] : first[d] + n_words[d]] * _ODD[: n_words[d]]).sum() + _ODD[64 + n_words[d]] for d in short], np.uint64)
        by = np.argsort(np.concatenate([owner, short]), kind="stable")
        x, owner = np.concatenate([x, extra])[by], np.concatenate([owner, short])[by]
    return bytescan.mixed(x), np.bincount(owner, minlength=n_docs)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


#: Minhashes whose two low bits make a node's signature, at most.
SIGNED = 64
_PAIRS = np.uint64(0x5555555555555555)


def _describe(size: int, sketches: int, rows: int):
    """mapInArrow: (doc_id, key, text) to (doc_id, key, n_shingles, d1, d2, sketch, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in bytescan.blocks(batches):
            x, counts = shingles(data, offsets, size)
            n = np.zeros(len(counts), np.int64)
            digest = np.zeros((2, len(counts)), np.uint64)
            for d, part in zip(np.flatnonzero(counts), np.split(x, np.cumsum(counts[counts > 0])[:-1]) if len(x) else []):
                part = _distinct(part)
                n[d] = len(part)
                digest[0, d] = bytescan.mixed(part ^ _ODD[100]).sum()
                digest[1, d] = bytescan.mixed(part ^ _ODD[101]).sum()
            sketch = np.zeros((len(counts), 2 * sketches), np.uint64)
            sig = np.zeros((len(counts), 2), np.uint64)
            if len(x):
                at, full = (np.cumsum(counts) - counts)[counts > 0], counts > 0
                for i in range(2 * sketches):
                    half = np.zeros(len(at), np.uint64)
                    for j in range(rows):
                        least = np.minimum.reduceat(x * _ODD[200 + i * rows + j], at)
                        half = bytescan.mixed(half + least)
                        if (bit := i * rows + j) < SIGNED:
                            sig[full, bit // 32] |= (bytescan.mixed(least) & np.uint64(3)) << np.uint64(2 * (bit % 32))
                    sketch[full, i] = half
            flat = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * m.shape[1]), len(counts), [None, pa.py_buffer(m.tobytes())]).cast(pa.binary()) for m in (sketch, sig)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), *flat], ["doc_id", "key", "n_shingles", "d1", "d2", "sketch", "sig"])

    return run


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of ``SIGNED`` two-bit pieces of two signatures (rows of two words) are equal."""
    differ = x ^ y
    return SIGNED - np.bitwise_count((differ | (differ >> np.uint64(1))) & _PAIRS).sum(-1, dtype=np.int64)


def cuts(percent: int, sketches: int, rows: int) -> tuple[int, int]:
    """(firm, loose): agreements from which a meeting closes as it is, and below which it is dropped.

    A piece agrees at similarity s with probability s + (1 - s) / 4. Loose lies
    five deviations below what a pair at the threshold has, so of links one in
    3,000,000 meetings is dropped; firm one deviation below it. Two documents at
    similarity 0.2 that meet pass as firm in one of 10^9 meetings.
    """
    n = min(SIGNED, 2 * sketches * rows)
    p = (1 + 3 * percent / 100) / 4
    sd = math.sqrt(n * p * (1 - p))
    same = SIGNED - n  # pieces that no minhash fills are equal
    return same + math.floor(n * p - sd), same + math.floor(n * p - 5 * sd)


_TABLE = "bucket int, keys binary, refs binary, nodes binary, sigs binary, dest int, a array<long>, b array<long>, firm boolean"
_TABLE_SCHEMA = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "refs", "nodes", "sigs")], ("dest", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("firm", pa.bool_())])
#: Bytes of a key that travel, beside its bucket.
_KEY = 5


def meetings(keys: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, firm: int, loose: int, every: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, is firm, rows of leaders): what the signatures of nodes with one key say.

    Each key's smallest node leads, and is compared with all of the key's nodes;
    those that agree firmly follow it. While nodes are left that follow none, the
    smallest of them leads in turn. Only leaders travel on with the key. A leader
    has a firm link to all that agree with it (without ``every`` only to those
    that follow it), and a loose one to the earlier leader it agrees with most.
    """
    by = np.lexsort((nodes, keys))
    k = keys[by]
    new = np.append(True, k[1:] != k[:-1])[: len(k)]
    key = np.cumsum(new) - 1
    left = np.bincount(key)[key] > 1 if len(key) else new
    lead = ~left
    rows = np.flatnonzero(left)
    most, nearest = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    while len(rows):
        waiting = rows[left[rows]]
        head = waiting[np.append(True, key[waiting][1:] != key[waiting][:-1])]
        doubt = head[most[head] >= loose]
        found.append((nodes[by[nearest[doubt]]], nodes[by[doubt]], np.zeros(len(doubt), bool)))
        of = np.searchsorted(key[head], key[rows])
        h, m = by[head[of]], by[rows]
        agree = agreement(sigs[h], sigs[m])
        follows = (agree >= firm) | (nodes[h] == nodes[m])
        tell = follows & (nodes[h] != nodes[m]) & (left[rows] | every)
        found.append((nodes[h][tell], nodes[m][tell], np.ones(tell.sum(), bool)))
        closer = agree > most[rows]
        most[rows[closer]], nearest[rows[closer]] = agree[closer], head[of[closer]]
        lead[head] = True
        left[rows[follows]] = False
        left[head] = False
        rows = rows[np.bincount(of, left[rows])[of] > 0]
    x, y, close = (np.concatenate(c) for c in zip(*found))
    a, b = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((~close, b, a))
    a, b, close = a[order], b[order], close[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[fresh], b[fresh], close[fresh], by[lead]


def _links(a: np.ndarray, b: np.ndarray, close: np.ndarray, tasks: int, contract: bool) -> Iterator[list[pa.Array]]:
    """Firm links, if wanted as a forest, and the loose ones that those don't imply, packed: dest, a, b, firm."""
    x, y = (a[close], b[close])
    if contract and len(x):
        x, y = forest(x, y)
        by = np.argsort(y)
        nodes, roots = y[by], x[by]
        root = lambda v: np.where(nodes[np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)] == v, roots[np.minimum(np.searchsorted(nodes, v), len(nodes) - 1)], v)
        a, b, close = (c[close | (root(a) != root(b))] for c in (a, b, close))
    for p, q, firm in ((x, y, True), (a[~close], b[~close], False)):
        if len(p):
            links = dealt(p, q, tasks)
            yield [*links, pa.array([firm] * len(links[0]))]


def _tables(sketches: int, buckets: int, tasks: int, contract: bool, firm: int, loose: int):
    """mapInArrow: (node, sketch, sig) to the tables' entries by bucket, each key's leaders of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy()
            half = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(nodes), 2 * sketches)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(nodes), 2)
            keys = np.concatenate([bytescan.mixed(half[:, i] * _ODD[900 + i] + half[:, sketches + j] + _ODD[1000 + i * sketches + j]) for i in range(sketches) for j in range(sketches)])
            owner = np.tile(np.arange(len(nodes)), sketches * sketches)
            a, b, close, lead = meetings(keys, nodes[owner], sig[owner], firm, loose, contract)
            for links in _links(a, b, close, tasks, contract):
                n = len(links[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 4, *links], schema=_TABLE_SCHEMA)
            keys, owner = keys[lead], owner[lead]
            bucket = ((keys >> np.uint64(8 * _KEY)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            out: list[list] = [[], [], [], [], []]
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                used, ref = np.unique(owner[part], return_inverse=True)
                low = keys[part].view(np.uint8).reshape(-1, 8)[:, :_KEY]
                for column, value in zip(out, (bucket[part[0]], low.tobytes(), ref.astype("<u2" if len(nodes) < 65536 else "<u4").tobytes(), nodes[used].tobytes(), sig[used].tobytes())):
                    column.append(value)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]], pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.list_(pa.int64()))] * 2, pa.nulls(n, pa.bool_())], schema=_TABLE_SCHEMA)

    return run


def _meet(tasks: int, contract: bool, firm: int, loose: int):
    """mapInArrow over a partition of table entries: links, packed by the task that is to have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sigs = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                low = np.frombuffer(row["keys"], np.uint8).reshape(-1, _KEY)
                k = np.zeros((len(low), 8), np.uint8)
                k[:, :_KEY] = low
                ref = np.frombuffer(row["refs"], f"<u{len(row['refs']) // len(k)}")
                keys.append(k.view(np.uint64).ravel() + (np.uint64(row["bucket"]) << np.uint64(8 * _KEY)))
                nodes.append(np.frombuffer(row["nodes"], np.int64)[ref])
                sigs.append(np.frombuffer(row["sigs"], np.uint64).reshape(-1, 2)[ref])
        if keys:
            parts = []
            for column in (keys, nodes, sigs):  # each list goes as soon as it is one array
                parts.append(np.concatenate(column))
                column.clear()
            a, b, close, _ = meetings(*parts, firm, loose, contract)
            for links in _links(a, b, close, tasks, contract):
                yield pa.RecordBatch.from_arrays(links, ["dest", "a", "b", "firm"])

    return run


def _met(nodes: DataFrame, sketches: int, percent: int, rows: int, contract: bool) -> DataFrame:
    """(node, sketch, sig) to links of nodes that share a table key, packed as (dest, a list, b list, firm)."""
    n, limits = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), cuts(percent, sketches, rows)
    entries = scratch(nodes.select("node", "sketch", "sig").mapInArrow(_tables(sketches, 2 * n, n, contract, *limits), _TABLE), "tables")
    here = entries.where("a IS NOT NULL").select("dest", "a", "b", "firm")
    there = entries.where("a IS NULL").select("bucket", "keys", "refs", "nodes", "sigs").repartition(n, "bucket")
    return here.unionByName(there.mapInArrow(_meet(n, contract, *limits), "dest int, a array<long>, b array<long>, firm boolean"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets' similarity is at least ``percent``.

    ``sets`` is (node, set). A node that many pairs have as their smaller end
    goes to as many tasks as there are shuffle partitions, at most.
    """
    pairs = scratch(pairs.distinct().join(sets.withColumnRenamed("node", "b"), "b"), "pairs")
    return spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("other")), ["a"], "b").select("a", "b", "set", "other").mapInArrow(_verify(percent), "a long, b long")


def _exploded(links: DataFrame) -> DataFrame:
    pairs = links.select(F.explode(F.arrays_zip("a", "b")).alias("e"))
    return pairs.select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))


def _sets(size: int, carry: list[str]):
    """mapInArrow: adds the sorted distinct shingles of ``text`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in bytescan.blocks(batches):
            x, counts = shingles(data, offsets, size)
            sets = [_distinct(part).tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
            columns = [block.column(block.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], [*carry, "set"])

    return run


def intersections(rows: list[np.ndarray], columns: list[np.ndarray] | None = None, room: int = 4 << 20) -> np.ndarray:
    """Sizes of the intersections of each of ``rows`` with each of ``columns`` (or of ``rows``)."""
    left, right = len(rows), len(columns or ())
    sets = [*rows, *(columns or ())]
    token = np.concatenate(sets)
    by = np.argsort(token)
    token = token[by]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[by]
    del by
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    del token
    shared = ~new
    shared[:-1] |= ~new[1:]
    owner, new = owner[shared], new[shared]
    at = np.cumsum(new, dtype=np.int32) - 1
    out = np.zeros((left, right or left), np.float32)
    step = max(1, room // len(sets))
    edges = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else -1) + step + 1, step))
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], at[lo:hi] % step] = 1
        out += m[:left] @ (m[left:] if right else m).T
    return out.astype(np.int64)


def _similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def clusters(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest index of each set's cluster under exact links."""
    n = np.array([len(s) for s in sets])
    linked = _similar(intersections(sets), n[:, None], n[None, :], percent)
    label = np.arange(len(sets))
    while True:
        new = np.where(linked, label[None, :], len(sets)).min(1)
        new = np.minimum(new, label)[np.minimum(new, label)]
        if (new == label).all():
            return label
        label = new


def _by_group(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[dict[str, list]]:
    """Consecutive rows that agree in ``group``, as columns."""
    held: dict[str, list] | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is None or any(held[c][-1] != row[c] for c in group):
                if held:
                    yield held
                held = {c: [] for c in row}
            for c, v in row.items():
                held[c].append(v)
    if held:
        yield held


def _cluster(percent: int):
    """mapInArrow over rows (component, node, set) sorted by component: links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _by_group(batches, ["component"]):
            by = np.argsort(np.array(g["node"]))
            node = np.array(g["node"])[by]
            label = clusters([np.frombuffer(g["set"][i], np.uint64) for i in by], percent)
            away = label != np.arange(len(label))
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[label[away]]), pa.array(node[away])], ["a", "b"])

    return run


def _verify(percent: int):
    """mapInArrow: (a, b, set, other) to the pairs (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(bool(_similar(np.count_nonzero(y[at] == x), len(x), len(y), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _cross(percent: int):
    """mapInArrow over rows (component, part, block, outside, node, part_of, set), sorted: links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _by_group(batches, ["component", "part", "block"]):
            outside = np.array(g["outside"])
            if outside.all() or not outside.any():
                continue
            node, of = np.array(g["node"]), np.array(g["part_of"])
            sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
            o, k = np.flatnonzero(outside), np.flatnonzero(~outside)
            inter = intersections([sets[i] for i in o], [sets[i] for i in k])
            n = np.array([len(s) for s in sets])
            linked = _similar(inter, n[o][:, None], n[k][None, :], percent) & (of[o][:, None] != of[k][None, :])
            x, y = np.nonzero(linked)
            # one link from a node to each cluster is enough
            _, first = np.unique(np.stack([x, of[k][y]], 1), axis=0, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(node[o][x[first]]), pa.array(node[k][y[first]])], ["a", "b"])

    return run


def _cluster_large(nodes: DataFrame, members: DataFrame, sketches: int, percent: int, rows: int, n: int) -> DataFrame:
    """Links within groups too large for a task; ``members`` is (component, node, set)."""
    sets = members.select("node", "set")
    met = _met(nodes.join(members.select("node"), "node"), sketches, percent, rows, contract=False)
    links = scratch(_verified(_exploded(met), sets, percent), "hub_links")
    part_of = components(links).withColumnRenamed("component", "part_of")
    labelled = members.select("component", "node").join(nodes.select("node", "n_shingles"), "node").join(part_of, "node", "left").withColumn("part_of", F.coalesce("part_of", "node"))
    labelled = scratch(labelled, "labelled")
    size = labelled.groupBy("component", "part_of").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    largest = F.struct("m", "part_of", "s")
    main = size.groupBy("component").agg(F.max(largest).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    parts = F.greatest(F.ceil(F.col("m") / PART_NODES), F.ceil(F.col("s") / PART_SHINGLES))
    blocks = F.greatest(F.ceil((F.col("m") - F.col("main.m")) / BLOCK_NODES), F.ceil((F.col("s") - F.col("main.s")) / BLOCK_SHINGLES))
    main = main.where("main.m < m").select("component", F.col("main.part_of").alias("main"), parts.cast("int").alias("parts"), blocks.cast("int").alias("blocks"))
    rows = labelled.drop("n_shingles").join(main, "component").join(sets, "node")
    outside = rows.where("part_of <> main").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shape = lambda df, o: df.select("component", "part", "block", F.lit(o).alias("outside"), "node", "part_of", "set")
    pairs = shape(outside, True).unionByName(shape(every, False)).repartition(n, "component", "part", "block").sortWithinPartitions("component", "part", "block")
    return links.unionByName(pairs.mapInArrow(_cross(percent), "a long, b long"))


def sketches_for(percent: int, rows: int = ROWS) -> int:
    """How many sketches a side keep a pair at the threshold with a loss of ``LOSS`` at most."""
    differ = 1 - (percent / 100) ** rows
    return max(2, math.ceil(math.log(LOSS / 2) / math.log(differ))) if differ > 0 else 2


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, group_nodes: int = GROUP_NODES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 x |intersection| >= percent x |union| of their
    sets of ``words``-word shingles; a component is what links reach, named by
    its smallest id, which alone is kept. A null, empty or blank text has an
    empty set and is linked with nothing. A null id is larger than any id;
    ``component_id`` is null where all of a component's ids are. Rows that repeat
    an id and text are in one component and all kept or dropped. An empty table
    gives an empty result; other columns are not read.
    """
    return _near_dedup(docs, words, percent, id_col, text_col, rows, group_nodes).drop("key")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are not their component's smallest id; all columns stay.

    Null, empty and blank texts are like nothing and all stay; a null id stays
    only where its component has no other id; rows that repeat an id and text all
    stay or all go; an empty table stays empty.
    """
    gone = _near_dedup(docs, words, percent, id_col, text_col, ROWS, GROUP_NODES).where("NOT kept").select("doc_id", F.col("key").alias("proof"), F.col("key").alias("digest"))
    id_ = F.col(id_col).cast("long")
    key = F.xxhash64(id_, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return drop_rows(docs, gone, id_, key, key)


def _texts_of(base: DataFrame, nodes: DataFrame, wanted: DataFrame, carry: list[str], words: int) -> DataFrame:
    """The sets of ``wanted`` (node and columns to carry), from the text of each node's first document."""
    rows = wanted.join(nodes.select("node", "doc_id", "key"), "node")
    texts = base.join(rows, ["doc_id", "key"]).dropDuplicates(["node"])
    schema = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in carry)
    return scratch(texts.select(*carry, "text").mapInArrow(_sets(words, carry), f"{schema}, set binary"), "sets")


def _near_dedup(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, rows: int, group_nodes: int) -> DataFrame:
    n, sketches = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sketches_for(percent, rows)
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc_id"), F.xxhash64(id_, text).alias("key"), text.alias("text"))
    seen = scratch(base.mapInArrow(_describe(words, sketches, rows), "doc_id long, key long, n_shingles long, d1 long, d2 long, sketch binary, sig binary"), "described")
    same = ["d1", "d2", "n_shingles"]
    nodes = seen.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("sketch").alias("sketch"), F.first("sig").alias("sig"))
    # numbers, not hashes: no two nodes share one; the written table fixes them
    nodes = scratch(nodes.select(F.monotonically_increasing_id().alias("node"), *same, "first.doc_id", "first.key", "sketch", "sig"), "nodes")
    met = scratch(_met(nodes, sketches, percent, rows, contract=True), "met", 100)  # a row has thousands of keys
    doubtful = scratch(_exploded(met.where("NOT firm")).distinct(), "doubtful")
    sets = _texts_of(base, nodes, doubtful.select(F.col("a").alias("node")).union(doubtful.select("b")).distinct(), ["node"], words)
    close = _verified(doubtful, sets, max(1, 100 - 3 * (100 - percent)))
    packed = close.select(F.pmod(F.xxhash64("b"), F.lit(n)).cast("int").alias("dest"), F.array("b").alias("a"), F.array("a").alias("b"))
    groups = components(met.where("firm").select("dest", "a", "b").unionByName(packed))
    sized = groups.join(nodes.select("node", "n_shingles"), "node")
    size = sized.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    large = scratch(size.select("component", ((F.col("m") > group_nodes) | (F.col("s") > GROUP_SHINGLES)).alias("large")), "sizes")
    wanted = spread_join(scratch(groups, "groups"), large, ["component"], "node")
    with_sets = _texts_of(base, nodes, wanted, ["component", "node", "large"], words)
    small = with_sets.where("NOT large").repartition(n, "component").sortWithinPartitions("component").select("component", "node", "set")
    links = small.mapInArrow(_cluster(percent), "a long, b long")
    if not large.where("large").isEmpty():
        more = components(_cluster_large(nodes, with_sets.where("large").select("component", "node", "set"), sketches, percent, rows, n))
        links = links.unionByName(more.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b"))
    # within a task or by `components` each link already leads to its root
    root = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    rooted = scratch(nodes.select("node", "doc_id", *same).join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = spread_join(rooted.drop("doc_id"), ids, ["root"], "node").select(*same, "component_id")
    done = spread_join(seen.select("doc_id", "key", *same), scratch(placed, "placed"), same, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return done.select("key", F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(_LAST)).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM w, unnest(range(0, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON a = r
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n
"""
