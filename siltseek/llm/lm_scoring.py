"""LM scoring: context-tree weighting, beside an add-one unigram base.

Training counts every (context, byte) gram and every token of the training
documents. Tasks send each distinct gram or token once with its count. Every
context of the training bytes is a node of the tree and every token one of the
vocabulary, so both grow with the input. The tree is kept in parts by the last
two bytes of the context; the driver sees only what the contexts of no and one
byte say. A document's scores are put together where the counts are: grams and
tokens above a fixed share of the training bytes or tokens (a bounded number)
are looked up in a broadcast table, and the others travel, with the documents
that use them, to the task that knows their part of the tree or their counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan, context_tree
from siltseek.llm.scratch import scratch

DEPTH = 5
#: Tokens with at least this share of the training tokens are broadcast: 65,536 at most.
HEAD_SHARE = 1 / 65_536
#: Grams with at least this share of the training bytes are broadcast with their costs: 1,048,576 at most.
HEAD_GRAMS = 1 / 1_048_576
#: Distinct keys a task holds before it sends them on.
_HELD = 3_000_000
_END_KEY = np.uint64(0x5EED)
_LAST = (1 << 63) - 1


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes, all first bytes before all second ones: sorted or small ones compress well so."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each lower-cased word and of each document's end, by hash."""
    data = bytescan.LOWER[data]
    start, end, doc = bytescan.words(data, offsets)
    n = len(offsets) - 1
    key = np.concatenate([bytescan.Sums(data).hashes(start, end), np.full(n, _END_KEY)])
    doc = np.concatenate([doc, np.arange(n)])
    by = np.argsort(key, kind="stable")
    return key[by], doc[by]


def _bucket(kind: str, key: np.ndarray, buckets: int) -> np.ndarray:
    """Where a key's count is kept; grams whose contexts share the last two bytes stay together."""
    shuffled = bytescan.mixed((key >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == "gram" else key
    return (shuffled % np.uint64(buckets)).astype(np.int32)


class _Held:
    """Counts by key, merged now and then, sent on by bucket."""

    def __init__(self, kind: str, buckets: int) -> None:
        self.kind, self.buckets = kind, buckets
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, n: np.ndarray) -> bool:
        """Whether, merged, there is more than a task should hold."""
        self.parts.append((key, n))
        if sum(len(k) for k, _ in self.parts) > _HELD:
            self.merge()
            return len(self.parts[0][0]) > _HELD // 2
        return False

    def merge(self) -> None:
        key, n = (np.concatenate(x) for x in zip(*self.parts))
        by = np.argsort(key, kind="stable")
        self.parts = [context_tree.summed(key[by], n[by])]

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self.merge()
        key, n = self.parts.pop()
        bucket = _bucket(self.kind, key, self.buckets)
        by = np.argsort(bucket, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
        columns = [[self.kind] * len(parts), [bucket[p[0]] for p in parts], [_planes(key[p], "<u8") for p in parts], [_planes(n[p], "<i8") for p in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "bucket", "keys", "counts"])


def _count(depth: int, buckets: int):
    """mapInArrow: (text) of training documents to (kind, bucket, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = _Held("gram", buckets), _Held("word", buckets)
        for _, data, offsets in bytescan.blocks(batches):
            key, _ = _tokens(data, offsets)
            if words.add(*context_tree.summed(key, np.ones(len(key), np.int64))):
                yield from words.send()
            if grams.add(*context_tree.grams(*context_tree.streams(data, offsets), depth)):
                yield from grams.send()
        yield from words.send()
        yield from grams.send()

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over a partition: a row per bucket of grams; the words of the partition in one row."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault((row["kind"], row["bucket"] if row["kind"] == "gram" else -1), []).append((_numbers(row["keys"], "<u8"), _numbers(row["counts"], "<i8")))
    names = ["kind", "bucket", "key", "n", "keys", "counts"]
    for (kind, bucket), parts in found.items():
        key, n = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(key, kind="stable")
        key, n = context_tree.summed(key[by], n[by])
        # in the row's plain columns: how many keys, how many occurrences
        yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([len(key)]), pa.array([int(n.sum())]), pa.array([_planes(key, "<u8")], pa.binary()), pa.array([_planes(n, "<i8")], pa.binary())], names)


def _heads(least: float):
    """mapInArrow: word rows to (key, n) of the words with at least ``least`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = _numbers(row["keys"], "<i8"), _numbers(row["counts"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(key[n >= least]), pa.array(n[n >= least])], ["key", "n"])

    return run


def _gram_counts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The (gram, count) arrays of gram rows."""
    return tuple(np.concatenate([_numbers(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("counts", "<i8")))


def _upwards(depth: int):
    """mapInArrow: gram rows to (last, bucket, symbols, below) by a context's last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                last, symbols, below = context_tree.Subtrees(*_gram_counts([row]), depth).totals()
                yield pa.RecordBatch.from_arrays([pa.array(last), pa.array([row["bucket"]] * len(last), pa.int32()), pa.array([x.tobytes() for x in symbols], pa.binary()), pa.array([x.tobytes() for x in below], pa.binary())], ["last", "bucket", "symbols", "below"])

    return run


def _sum_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by (last, bucket): their sums by last byte."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            part = [np.frombuffer(r["symbols"], "<f8"), np.frombuffer(r["below"], "<f8")]
            sums[r["last"]] = [a + b for a, b in zip(sums[r["last"]], part)] if r["last"] in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *[pa.array([v[i].tobytes() for v in sums.values()], pa.binary()) for i in (0, 1)]], ["last", "symbols", "below"])


def train_top(grams: DataFrame, depth: int) -> context_tree.Top:
    """What the contexts of no and one byte say; the driver sees at most 256 rows of 4 kB."""
    n = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = grams.mapInArrow(_upwards(depth), "last long, bucket int, symbols binary, below binary")
    rows = totals.repartition(n, "last").sortWithinPartitions("last", "bucket").mapInArrow(_sum_totals, "last long, symbols binary, below binary").collect()
    symbols, below = np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        symbols[r["last"]], below[r["last"]] = np.frombuffer(r["symbols"], "<f8"), np.frombuffer(r["below"], "<f8")
    return context_tree.top(symbols, below)


def _head_costs(top, depth: int, least: float):
    """mapInArrow: gram rows to (key, cost) of the grams with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = _gram_counts([row])
                if (n >= least).any():
                    cost = context_tree.Subtrees(key, n, depth).costs(top.value)
                    yield pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64)), pa.array(cost[n >= least])], ["key", "cost"])

    return run


_SCORED = "kind string, bucket int, block long, keys binary, train binary, pairs binary, docs binary, times binary, doc_ids array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"


def _pairs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, document, times) of the distinct grams of each document, by gram."""
    stream, at = context_tree.streams(data, offsets)
    key = context_tree.keys(stream, at, depth)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    if depth <= 5:  # a gram of at most six bytes and a document's number in its block fit in 64 bits
        key = (key << np.uint64(16)) | doc
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        one, own = key[first] >> np.uint64(16), key[first] & np.uint64(0xFFFF)
    else:
        by = np.lexsort((doc, key))
        key, doc = key[by], doc[by]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        one, own = key[first], doc[first]
    return one, own.astype(np.int64), np.diff(np.append(first, len(key)))


def _travelling(kind: str, buckets: int, block: int, pk: np.ndarray, pd: np.ndarray, times: np.ndarray, held: np.ndarray) -> list[pa.Array]:
    """Rare keys by bucket, from (key, document, times) sorted by key: per key its training
    count here and the documents with their numbers of it."""
    token = np.flatnonzero(np.append(True, pk[1:] != pk[:-1]))
    pairs = np.diff(np.append(token, len(pk)))
    # how often training has a gram is in its part of the tree; a word's count is put together from these
    train = np.add.reduceat(np.where(held[pd], 0, times), token) if kind == "word" else None
    bucket = _bucket(kind, pk[token], buckets)
    by = np.argsort(bucket, kind="stable")
    first = np.cumsum(pairs) - pairs
    out: list[list] = [[] for _ in range(6)]
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        size = pairs[part]
        inside = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        values = (bucket[part[0]], _planes(pk[token[part]], "<u8"), None if train is None else _planes(train[part], "<u4"), _planes(size, "<u2"), _planes(pd[inside], "<u2"), _planes(times[inside], "<u4"))
        for column, v in zip(out, values):
            column.append(v)
    n = len(out[0])
    return [pa.array([kind] * n), pa.array(out[0], pa.int32()), pa.array([block] * n), *[pa.array(c, pa.binary()) for c in out[1:]]]


def _score(model, buckets: int, depth: int):
    """mapInArrow: (doc_id, held_out, text) to a row per block, and its rare grams and tokens by bucket."""
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.float64())] * 2]
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_key, gram_cost, head_key, head_n = model.value
        head_value = np.log10(head_n + 1.0)
        for rows, data, offsets in bytescan.blocks(batches):
            n_docs = rows.num_rows
            held = rows.column(1).to_numpy(zero_copy_only=False)
            gram, owner, often = _pairs(data, offsets, depth)
            place = np.minimum(np.searchsorted(gram_key, gram), max(0, len(gram_key) - 1))
            frequent = gram_key[place] == gram if len(gram_key) else np.zeros(len(gram), bool)
            score = np.bincount(owner[frequent], gram_cost[place[frequent]] * often[frequent], n_docs)
            key, doc = _tokens(data, offsets)
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            runs = np.diff(np.append(at, len(key)))
            one = key[at]
            place = np.minimum(np.searchsorted(head_key, one), max(0, len(head_key) - 1))
            common = head_key[place] == one if len(head_key) else np.zeros(len(one), bool)
            token_common = np.repeat(common, runs)
            value = np.repeat(np.where(common, head_value[place] if len(head_key) else 0, 0), runs)
            base = np.bincount(doc, value, n_docs)
            known = np.bincount(doc[token_common], minlength=n_docs)
            n_tokens = np.bincount(doc, minlength=n_docs)
            block = int.from_bytes(os.urandom(8), "little") >> 1
            lists = [bytescan.list_column(v, np.array([n_docs]), k.value_type) for v, k in zip((rows.column(0).to_numpy(), held, n_tokens, known, base, score), kinds[8:])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.array([block]), *[pa.nulls(1, pa.binary())] * 5, *lists], names)
            rare = ~frequent
            travel = [("gram", gram[rare], owner[rare], often[rare])]
            rare = ~token_common
            k, d = key[rare], doc[rare]
            pair = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, np.int64)
            travel.append(("word", k[pair], d[pair], np.diff(np.append(pair, len(k)))))
            for kind, pk, pd, times in travel:
                if len(pk):
                    columns = _travelling(kind, buckets, block, pk, pd, times, held)
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(columns[0]), c) for c in kinds[8:]]], names)

    return run


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over a partition of rare tokens: per block, each document's sum and known tokens."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    keys = [_numbers(r["keys"], "<u8") for r in rows]
    train = np.concatenate([_numbers(r["train"], "<u4") for r in rows]).astype(np.int64)
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by][1:] != key[by][:-1])
    total = np.add.reduceat(train[by], np.flatnonzero(new))
    count = np.empty(len(key), np.int64)
    count[by] = total[np.cumsum(new) - 1]
    sums: dict[int, list] = {}
    first = 0
    for r, k in zip(rows, keys):
        c, first = count[first : first + len(k)], first + len(k)
        size = _numbers(r["pairs"], "<u2")
        docs, times = _numbers(r["docs"], "<u2").astype(np.int64), _numbers(r["times"], "<u4")
        value, known = np.repeat(np.log10(c + 1.0), size) * times, np.repeat(c > 0, size) * times
        sums.setdefault(r["block"], []).append((docs, value, known))
    out: list[list] = [[], [], []]
    for block, parts in sums.items():
        docs, value, known = (np.concatenate(x) for x in zip(*parts))
        for column, v in zip(out, (block, np.bincount(docs, value).tobytes(), np.bincount(docs, known).tobytes())):
            column.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["block", "sums", "known"])


def _rare_grams(top, depth: int):
    """mapInArrow over a partition of gram counts and rare grams: per block, each document's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        asked = [r for r in rows if r["block"] is not None]
        if not asked:
            return
        keys = [_numbers(r["keys"], "<u8") for r in asked]
        # a gram that training has not seen is one of no occurrences, which changes no other
        key, n = np.concatenate(keys), np.zeros(sum(map(len, keys)), np.int64)
        if len(asked) < len(rows):
            key, n = (np.concatenate(x) for x in zip((key, n), _gram_counts([r for r in rows if r["block"] is None])))
        by = np.argsort(key, kind="stable")
        key, n = context_tree.summed(key[by], n[by])
        cost = context_tree.Subtrees(key, n, depth).costs(top.value)
        sums: dict[int, list] = {}
        for r, k in zip(asked, keys):
            value = np.repeat(cost[np.searchsorted(key, k)], _numbers(r["pairs"], "<u2")) * _numbers(r["times"], "<u4")
            sums.setdefault(r["block"], []).append((_numbers(r["docs"], "<u2").astype(np.int64), value))
        packed = [np.bincount(*(np.concatenate(x) for x in zip(*parts))).tobytes() for parts in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary())], ["block", "tree"])

    return run


def _finish(total: int, distinct: int):
    """mapInArrow over rows sorted by block: one row per document."""
    log_total = np.log10(total + distinct + 1.0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def flush(row: dict, base: np.ndarray, known: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        n = np.array(row["n_tokens"], np.int64)
        m = len(n)
        values = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(known), pa.array(np.full(m, total)), pa.array(base - n * log_total), pa.array(score)]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, base, known, score = None, None, None, None, None
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != at:
                    if row is not None:
                        yield flush(row, base, known, score)
                    at, row, held = r["block"], None, []
                if r["doc_ids"] is not None:
                    row = r
                    base, known, score = np.array(r["base"]), np.array(r["n_known"], np.int64), np.array(r["score"])
                else:
                    held.append(r)
                if row is not None:
                    for x in held:
                        if x["tree"] is not None:
                            t = np.frombuffer(x["tree"], "<f8")
                            score[: len(t)] += t
                            continue
                        s, k = np.frombuffer(x["sums"], "<f8"), np.frombuffer(x["known"], "<f8")
                        base[: len(s)] += s
                        known[: len(k)] += k.astype(np.int64)
                    held = []
        if row is not None:
            yield flush(row, base, known, score)

    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(id as text) modulo ``folds`` is not
    ``held_fold``. ``score`` is the log10 probability the context tree gives the
    document's token sequence, ``base_score`` that of the add-one unigram; both
    cover every token and the end. A null or empty text is the end alone; a null
    id counts as an id of remainder 0; every row is scored, repeated ones too.
    With no training documents all bits are even odds. Other columns are not
    read; an empty table gives an empty result. Contexts have at most ``depth``
    bytes, 2 to 7.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(id_.cast("string")) % folds == held_fold, F.lit(False))
    base = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sent = base.where("NOT held_out").select("text").mapInArrow(_count(depth, 4 * n), "kind string, bucket int, keys binary, counts binary")
    counts = scratch(sent.repartition(n, "bucket").mapInArrow(_sum_counts, "kind string, bucket int, key long, n long, keys binary, counts binary"), "counts")
    words = counts.where("kind = 'word'")
    size = words.agg(F.coalesce(F.sum("key"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    heads = words.select("keys", "counts").mapInArrow(_heads(max(1.0, size["total"] * HEAD_SHARE)), "key long, n long").toArrow()
    head_key, head_n = heads.column("key").to_numpy().astype(np.int64).view(np.uint64), heads.column("n").to_numpy()
    by = np.argsort(head_key)
    grams = counts.where("kind = 'gram'").select("bucket", "keys", "counts")
    top = spark.sparkContext.broadcast(train_top(grams, depth))
    read = counts.where("kind = 'gram'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    costs = grams.mapInArrow(_head_costs(top, depth, max(1.0, read * HEAD_GRAMS)), "key long, cost double").toArrow()
    gram_key, gram_cost = costs.column("key").to_numpy().astype(np.int64).view(np.uint64), costs.column("cost").to_numpy()
    of = np.argsort(gram_key)
    model = spark.sparkContext.broadcast((gram_key[of], gram_cost[of], head_key[by], head_n[by]))
    scored = scratch(base.mapInArrow(_score(model, 4 * n, depth), _SCORED), "scored")
    asked = scored.where("kind = 'gram'").select("bucket", "block", "keys", "pairs", "docs", "times").unionByName(grams, allowMissingColumns=True)
    deep = asked.repartition(n, "bucket").mapInArrow(_rare_grams(top, depth), "block long, tree binary")
    rare = scored.where("kind = 'word'").select("bucket", "block", "keys", "train", "pairs", "docs", "times").repartition(n, "bucket").mapInArrow(_rare, "block long, sums binary, known binary")
    whole = scored.where("doc_ids IS NOT NULL").select("block", "doc_ids", "held", "n_tokens", "n_known", "base", "score")
    both = whole.unionByName(rare, allowMissingColumns=True).unionByName(deep, allowMissingColumns=True).select("block", "doc_ids", "held", "n_tokens", "n_known", "base", "score", "sums", "known", "tree")
    done = both.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_finish(size["total"], size["distinct"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
