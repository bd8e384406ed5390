"""Quality classifier: Bradley-Terry ranking from preference pairs.

A labelled good text is preferred to a labelled bad one. Weights w are learnt by
logistic loss on the feature differences of such pairs, P(a preferred to b) =
1 / (1 + exp(-w (x_a - x_b))), and a document's score is w x. Every labelled
training document takes part: documents are dealt into blocks by a hash of the id,
and all pairs of a block are compared. The threshold is the quantile of all
training scores at the share of bad documents; scores are shifted so that it
lies at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan
from siltseek.llm.labelled import LAST, held_out
from siltseek.llm.scratch import scratch

CUT = 0.3
_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "space": [0x20, *range(0x09, 0x0E)],
    "newline": [0x0A],
    "stop": [ord(c) for c in ".,;:"],
    "loud": [ord(c) for c in "!?"],
    "rule": [ord(c) for c in "|_=-+/\\<>[]{}()"],
    "symbol": [ord(c) for c in "#$%&*@^~`\"'"],
    "high": [*range(128, 256)],
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per document of a block, from its whole text."""
    n_docs = len(offsets) - 1
    sizes = np.diff(offsets)
    columns = []
    size1 = np.maximum(sizes, 1)
    full = np.flatnonzero(sizes)
    share = {}
    for name, codes in _CLASSES.items():
        table = np.zeros(256, np.int64)
        table[codes] = 1
        share[name] = np.zeros(n_docs)
        if len(full):
            share[name][full] = np.add.reduceat(table[data], offsets[:-1][full])
        columns.append(share[name] / size1)
    columns.append(share["upper"] / np.maximum(share["upper"] + share["lower"], 1))
    lower = bytescan.LOWER[data]
    start, end, doc = bytescan.words(lower, offsets)
    n = np.bincount(doc, minlength=n_docs)
    n1 = np.maximum(n, 1)
    length = (end - start).astype(float)
    mean = np.bincount(doc, length, n_docs) / n1
    columns += [np.log1p(sizes), np.log1p(n), mean, np.sqrt(np.maximum(np.bincount(doc, length**2, n_docs) / n1 - mean**2, 0))]
    columns.append(np.bincount(doc[length == 1], minlength=n_docs) / n1)
    key = bytescan.Sums(lower).hashes(start, end)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    columns.append(np.bincount(doc[again], minlength=n_docs) / n1)
    by = np.lexsort((key, doc))
    fresh = np.append(True, (key[by][1:] != key[by][:-1]) | (doc[by][1:] != doc[by][:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(key)))
    owner = doc[by][at]
    columns.append(np.bincount(owner, minlength=n_docs) / n1)
    p = runs / n1[owner]
    columns.append(np.bincount(owner, -p * np.log(p), n_docs) / np.maximum(np.log(n1), 0.5))
    most = np.zeros(n_docs)
    np.maximum.at(most, owner, p)
    columns.append(most)
    return np.stack(columns, 1)


_WIDTH = features(np.zeros(0, np.uint8), np.zeros(1, np.int64)).shape[1]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry score of feature rows."""
        return _expanded((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.rank(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.concatenate([x, x * x], 1)


#: Documents of the larger class a block, and about the least of the other one.
BLOCK, PARTNERS = 512, 64


def blocks_of(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """(block, label, x) of labelled rows (_id, label, x): each row is in a block, with rows of the other class.

    A block has about BLOCK rows of the larger class, each in one block; where the
    other class has too few rows for all blocks, they are in several.
    """
    larger = int(good >= bad)
    blocks = -(-max(good, bad) // BLOCK)
    shares = max(1, min(blocks, min(good, bad) // PARTNERS))
    h = F.xxhash64("_id", F.lit(11))
    once = rows.where(F.col("label") == larger).select(F.pmod(h, F.lit(blocks)).alias("block"), "label", "x")
    share = F.pmod(h, F.lit(shares))
    again = rows.where(F.col("label") != larger).select(F.explode(F.sequence(share, F.lit(blocks - 1), F.lit(shares))).alias("block"), "label", "x")
    return once.unionByName(again.select("block", "label", "x"))


def _pair_sums(shared):
    """Number, gradient and curvature of the pairs' loss, summed over the blocks of a task (rows by block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = shared.value
        total, held = np.zeros(1 + len(w) + len(w) ** 2), []

        def add(part: pa.RecordBatch) -> None:
            z = _expanded((_numbers(part.column(2)) - mean) / scale)
            good = part.column(1).to_numpy(zero_copy_only=False) == 1
            a, b = z[good], z[~good]
            if not len(a) or not len(b):
                return
            for i in range(0, len(a), BLOCK):  # a block's product of classes is bounded in memory
                for j in range(0, len(b), BLOCK):
                    x, y = a[i : i + BLOCK], b[j : j + BLOCK]
                    p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - (y @ w), -30, 30)))
                    c = p * (1 - p)
                    cross = x.T @ c @ y
                    curvature = (x * c.sum(1)[:, None]).T @ x + (y * c.sum(0)[:, None]).T @ y - cross - cross.T
                    total[:] += np.concatenate([[p.size], (1 - p).sum(1) @ x - (1 - p).sum(0) @ y, curvature.ravel()])

        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:]):
                if held and i < j and held[0].column(0)[0].as_py() != block[i]:
                    add(pa.concat_batches(held))
                    held = []
                held += [batch.slice(i, j - i)] if i < j else []
        if held:
            add(pa.concat_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "v"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nth(rows: DataFrame, column: str, n: int) -> float:
    """The ``n``-th smallest value (from 0) by counts in ever finer bins: no sort, at most 1,024 rows to the driver."""
    seen = rows.agg(F.min(column), F.max(column)).first()
    low, high = float(seen[0]), float(seen[1])
    while low < high and (high - low) / 1024 > 0:
        bin_ = F.least(F.floor((F.col(column) - low) / ((high - low) / 1024)), F.lit(1023))
        found = rows.where(F.col(column).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("bin").collect()
        for r in found:
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return low


def train(rows: DataFrame, ridge: float = 1e-3, rounds: int = 30) -> Model:
    """Newton steps on the pairs' logistic loss over all labelled rows (_id, label, x); with one class only, a constant score."""
    spark, width = rows.sparkSession, _WIDTH
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    good, bad = counts.get(1, 0), counts.get(0, 0)
    odds = float(np.log(CUT / (1 - CUT)))
    if not good or not bad:
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), odds + (5 if good or not bad else -5))
    sums = rows.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("place").collect()  # one row a feature
    mean, scale = np.array([r["mean"] for r in sums]), np.array([r["sd"] for r in sums]) + 1e-9
    blocked = scratch(blocks_of(rows, good, bad).repartition("block").sortWithinPartitions("block"), "blocks")
    w = np.zeros(2 * width)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((mean, scale, w))
        total = np.zeros(1 + len(w) + len(w) ** 2)
        for r in blocked.mapInArrow(_pair_sums(shared), "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():  # the curvature
            total[r["place"]] = r["v"]
        gradient = total[1 : 1 + len(w)] / total[0] - ridge * w
        curvature = total[1 + len(w) :].reshape(len(w), -1) / total[0] + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step * min(1.0, 3.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)
    shared = spark.sparkContext.broadcast(model)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.rank(_numbers(batch.column(0))))], ["s"])

    scores = scratch(rows.select("x").mapInArrow(rank, "s double"), "ranks")
    model.shift = odds - (nth(scores, "s", bad - 1) + nth(scores, "s", bad)) / 2
    return model


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in bytescan.blocks(batches):
        x = features(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), bytescan.list_column(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())], ["doc_id", "held_out", "x"])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, x): every document's features, written once; a null id is LAST."""
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(LAST)).alias("doc_id"), held_out(id_).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return scratch(rows.mapInArrow(_describe, "doc_id long, held_out boolean, x array<double>"), "features")


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.value.score(_numbers(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled training documents."""
    return _fitted(described(docs), labels)


def _fitted(rows: DataFrame, labels: DataFrame) -> Model:
    """Held-out rows, rows without a label of 0 or 1 and rows without an id are not learnt from; of an id's labels the larger counts."""
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    y = y.groupBy("_id").agg(F.max("label").alias("label"))
    return train(scratch(rows.withColumnRenamed("doc_id", "_id").join(y, "_id").select("_id", "label", "x"), "labelled"))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int").withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= CUT).

    A null or empty text has features of zero and is scored like any other; a
    null id counts as not held out; repeated rows are scored alike; an empty
    table gives an empty result; other columns are not read.
    """
    return _scored(described(docs, id_col, text_col), model)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    rows = described(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _scored(rows, _fitted(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
