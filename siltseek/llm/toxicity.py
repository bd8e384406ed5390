"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word, with a blank on either side, is its byte n-grams of 3 to 5 bytes, and a
text the mean of its n-grams' embeddings, so an unseen spelling shares most of
its vector with the known one. Embeddings and softmax are trained jointly by
gradient descent in NumPy. Because the text's vector is a mean, logits are means
of one number per n-gram; scoring looks up that number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan
from siltseek.llm.context_tree import END, streams
from siltseek.llm.labelled import LAST, held_out, labelled_sample, training_share
from siltseek.llm.scratch import scratch

BITS, DIM, SIZES = 18, 8, (3, 4, 5)
BUCKETS = 1 << BITS
_BLOCK = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """document x BUCKETS + bucket of every subword of a block's documents.

    The n-grams of a word are those of its bytes with a blank on either side.
    """
    stream, at = streams(data, offsets)
    padded = np.concatenate([np.array([0x20], np.uint8), np.where(stream == END, np.uint8(0x20), stream)])
    blank = padded == 0x20
    sums = bytescan.Sums(padded)
    doc_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = [np.zeros(0, np.int64)]
    for n in SIZES:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        inner = ~blank[1 : 1 + m]
        for j in range(2, n - 1):
            inner &= ~blank[j : j + m]
        place = np.flatnonzero(inner)
        bucket = (sums.hashes(place, place + n) >> np.uint64(64 - BITS)).astype(np.int64)
        found.append((doc_of[place] << BITS) + bucket)  # the n-gram's second byte is the stream's byte at `place`
    return np.concatenate(found)


@dataclass
class Bags:
    """The weight of each distinct subword in its document's mean.

    A subword counts 1 + ln(occurrences), so that a word repeated a thousand
    times does not drown the rest. Rows are sorted by document.
    """

    doc: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    docs: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Bags:
        key = grams(data, offsets)
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        doc, bucket = key[at] >> BITS, key[at] & (BUCKETS - 1)
        weight = 1 + np.log(np.diff(np.append(at, len(key))))
        total = np.bincount(doc, weight, len(offsets) - 1)
        return cls(doc.astype(np.int32), bucket.astype(np.int32), (weight / total[doc]).astype(np.float32), len(offsets) - 1)

    def times(self, per_bucket: np.ndarray) -> np.ndarray:
        """Each document's mean of a number per subword; without subwords 0."""
        return np.bincount(self.doc, self.share * per_bucket[self.bucket], self.docs)


@dataclass
class Model:
    """``value[bucket]`` is a subword's embedding through the softmax; ``bias`` the class bias."""

    value: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each document of a block."""
        logit = Bags.of(data, offsets).times(self.value) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def bags_of(texts: pa.Array) -> Bags:
    """The bags of many texts, a block at a time."""
    parts: list[list[np.ndarray]] = [[], [], []]
    docs = 0
    for _, data, offsets in bytescan.blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), limit=_BLOCK):
        b = Bags.of(data, offsets)
        for column, values in zip(parts, (b.doc + np.int32(docs), b.bucket, b.share)):
            column.append(values)
        docs += b.docs
    return Bags(*(np.concatenate(parts.pop(0)) for _ in range(3)), docs)


class _Sample:
    """Training bags over the subwords that occur in them; sums are made a slice at a time, for memory."""

    def __init__(self, bags: Bags) -> None:
        self.doc, self.share, self.docs = bags.doc, bags.share, bags.docs
        self.buckets = np.flatnonzero(np.bincount(bags.bucket, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        self.column = place[bags.bucket]

    def _sums(self, by: np.ndarray, values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for i in range(0, len(by), _BLOCK):
            part = slice(i, i + _BLOCK)
            out += np.bincount(by[part], self.share[part] * values[of[part]], n)
        return out

    def times(self, per_bucket: np.ndarray) -> np.ndarray:
        return self._sums(self.doc, per_bucket, self.column, self.docs)

    def transposed(self, per_doc: np.ndarray) -> np.ndarray:
        return self._sums(self.column, per_doc, self.doc, len(self.buckets)).astype(np.float32)


#: Weight of the text that says nothing, a clean one, beside a weight of 1 for all other texts.
NOTHING = 0.05


def train(bags: Bags, label: np.ndarray, share: float | None = None, dim: int = DIM, rounds: int = 500, enough: float = 0.03, rate: float = 300.0, momentum: float = 0.9, seed: int = 1) -> Model:
    """Joint gradient descent on embeddings, softmax weights and bias, by likelihood.

    The classes count alike, and so 0.5 is where a text is as likely of either
    one; an empty text is one more clean example, which is what the bias learns
    from. With one class only the score is ``share`` (that of the sample, if not
    given). Training stops at a mean loss of ``enough``.
    """
    seen = float(label.mean()) if len(label) else 0.0
    if not 0 < seen < 1:
        share = min(max(seen if share is None else share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    sample = _Sample(bags)
    del bags
    rng = np.random.default_rng(seed)
    embedding, weights, bias = rng.normal(0, 0.05, (len(sample.buckets), dim)).astype(np.float32), rng.normal(0, 1, (dim, 2)).astype(np.float32), 0.0
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    moving_e, moving_w, moving_b = np.zeros_like(embedding), np.zeros_like(weights), 0.0
    for _ in range(rounds):
        # a text's logits are its mean embedding times the weights, that is the mean of embedding times weights
        p = 1 / (1 + np.exp(-np.clip(sample.times(embedding @ (weights[:, 1] - weights[:, 0])) + bias, -60, 60)))
        nothing = 1 / (1 + np.exp(-bias))
        loss = -(weight * np.log(np.where(label == 1, p, 1 - p) + 1e-12)).sum()
        if loss < enough:
            break
        wrong = (p - label) * weight
        by_bucket = sample.transposed(wrong.astype(np.float32))[:, None] * np.array([[-1, 1]], np.float32)
        step_e, step_w = by_bucket @ weights.T, embedding.T @ by_bucket
        moving_e = momentum * moving_e + step_e
        moving_w = momentum * moving_w + step_w
        moving_b = momentum * moving_b + wrong.sum() + NOTHING * nothing
        embedding -= np.float32(rate) * moving_e
        weights -= np.float32(0.5) * moving_w
        bias -= 2 * moving_b
    value = np.zeros(BUCKETS, np.float32)
    value[sample.buckets] = embedding @ (weights[:, 1] - weights[:, 0])
    return Model(value, float(bias))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in bytescan.blocks(batches, limit=_BLOCK):
            score = model.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_bytes: int = 12 << 20) -> Model:
    """A model from at most ``per_class`` labelled training documents a class and ``max_bytes`` of text."""
    sample = labelled_sample(docs, labels, "toxic", per_class, max_bytes)
    if not sample.num_rows:
        return train(Bags(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), 0), np.zeros(0))
    share = training_share(labels, "toxic")
    return train(bags_of(sample.column("text").combine_chunks()), sample.column("label").to_numpy(), share)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    A null or empty text has no subwords and gets the score of the bias alone,
    which is below 0.5 where both classes were learnt from; a
    null id counts as not held out; repeated rows are scored alike; an empty
    table gives an empty result; other columns are not read.
    """
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(LAST)).alias("doc_id"), held_out(id_).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # written, which also bounds the rows of whole texts that a worker gets at a time
    scored = scratch(rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int"), "scored")
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def _clean(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            named = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            toxic = np.zeros(batch.num_rows, bool)
            for rows, data, offsets in bytescan.blocks(iter([named]), limit=_BLOCK):
                toxic[rows.column(1).to_numpy()] = model.value.score(data, offsets) >= 0.5
            yield batch.filter(pa.array(~toxic))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents the model does not reject (score below 0.5), with all their columns.

    Null and empty texts have the score of the bias alone; repeated rows all stay
    or all go; ids are not read; an empty table stays empty.
    """
    # written, which also bounds the rows of whole texts that a worker gets at a time
    return scratch(docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model), text_col), docs.schema), "clean")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
