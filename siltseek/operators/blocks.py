"""Exact standardised fusion for a block of questions, one matrix product a batch.

A row for every (question, document) pair grows with both sides. Here a
document is one row: its vector, its topics and the questions its words match.
A first pass over the documents sums each score and its square by question; a
second one computes the same products again, standardises with the finished
moments and keeps each batch's best k. Only sums and best lists leave a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siltseek.operators import lexical
from siltseek.operators.features import ragged
from siltseek.operators.fusion import LEAST_SD

#: Questions a block, documents a product.
QUESTIONS, DOCUMENTS = 512, 1024

#: Questions a block where each block reads the texts once, and shares of BM25 scores summed at a time.
ASKED, SHARES = 2048, 1 << 22


@dataclass
class Words:
    """Asked terms by number: the questions each is in (``count`` of them from ``first`` on) with their weights, and what BM25 needs."""

    first: np.ndarray
    count: np.ndarray
    questions: np.ndarray
    weights: np.ndarray
    idf: np.ndarray
    mean_terms: float
    k1: float
    b: float

    def scores(self, n_questions: int, words: np.ndarray, times: np.ndarray, row: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        """BM25 by question and document, of the terms ``words`` that occur ``times`` times in the documents ``row``."""
        weight = self.idf[words] * times * (self.k1 + 1) / (times + self.k1 * (1 - self.b + self.b * n_terms[row] / self.mean_terms))
        count, total = self.count[words], np.zeros(len(n_terms) * n_questions)
        upto = np.cumsum(count)
        at = 0
        while at < len(words):  # a document's terms always add up in the same order
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARES, "right")))
            share = ragged(self.first[words[at:end]], count[at:end])
            key = np.repeat(row[at:end] * n_questions, count[at:end]) + self.questions[share]
            low, high = row[at] * n_questions, (row[end - 1] + 1) * n_questions
            total[low:high] += np.bincount(key - low, self.weights[share] * np.repeat(weight[at:end], count[at:end]), high - low)
            at = end
        return total.reshape(-1, n_questions).T


@dataclass
class Questions:
    """A block: ids in order, dense vectors, unit topic vectors, weights of dense, BM25 and topics."""

    ids: list
    vectors: np.ndarray
    topics: np.ndarray
    weights: tuple[float, float, float]
    words: Words | None = None


def hybrid_blocks(asked: DataFrame, docs: DataFrame, terms: DataFrame, weights: tuple[float, float]) -> Iterator[tuple[Questions, DataFrame]]:
    """Blocks of questions (qid, terms, numbers) over documents (doc_id, numbers), by dense vectors and BM25.

    ``terms`` is (doc_id, terms) of the documents. Numbers may be null. The
    driver holds one block's questions at a time.
    """
    spark, rows = docs.sparkSession, asked.select("qid", "numbers").orderBy("qid").toLocalIterator()
    while block := list(itertools.islice(rows, QUESTIONS)):
        vectors = np.zeros((len(block), max([1, *(len(r["numbers"]) for r in block if r["numbers"])])))
        for i, r in enumerate(block):
            if r["numbers"]:
                vectors[i] = r["numbers"]
        ids = [r["qid"] for r in block]
        numbered = F.broadcast(spark.createDataFrame(list(enumerate(ids)), ["q", "qid"]))  # a block of questions
        own = asked.join(numbered, "qid").select(F.col("q").alias("qid"), "terms")
        index = lexical.build(terms, only=own.select(F.explode("terms").alias("term")))
        matched = lexical.scores(index, own).groupBy("doc_id").agg(F.collect_list(F.struct("qid", "bm25")).alias("m"))
        matched = matched.select("doc_id", F.col("m.qid").alias("asked"), F.col("m.bm25").alias("matched"))
        yield Questions(ids, vectors, np.zeros((len(ids), 1)), (*weights, 0.0)), docs.join(matched, "doc_id", "left")


def _products(q: Questions, batch: pa.RecordBatch) -> list[tuple[float, np.ndarray]]:
    """(weight, scores by question and document) of each scorer in use."""
    n, get = batch.num_rows, lambda c: batch.column(batch.schema.get_field_index(c))
    lengths = lambda c: np.repeat(np.arange(n), get(c).value_lengths().fill_null(0).to_numpy())
    values = lambda c: get(c).flatten().to_numpy(zero_copy_only=False)
    vectors = np.zeros((n, q.vectors.shape[1]))
    if batch.schema.get_field_index("counts") >= 0:  # sums of signs, of which the hashed vector is made
        row, x = lengths("counts"), values("counts")
        x = np.sign(x) * np.log1p(np.abs(x))
        vectors[row, values("places")] = x / np.sqrt(np.bincount(row, x * x, n))[row]
    elif batch.schema.get_field_index("places") >= 0:
        vectors[lengths("places"), values("places")] = values("numbers")
    else:
        vectors[lengths("numbers"), np.arange(len(lengths("numbers"))) % q.vectors.shape[1]] = values("numbers")
    found = [(q.weights[0], q.vectors @ vectors.T)]
    if q.weights[1]:
        if q.words:
            bm25 = q.words.scores(len(q.ids), values("words"), values("times"), lengths("words"), get("n_terms").to_numpy())
        else:
            bm25 = np.zeros((len(q.ids), n))
            bm25[values("asked"), lengths("asked")] = values("matched")
        found.append((q.weights[1], bm25))
    if q.weights[2]:
        topics = np.zeros((n, q.topics.shape[1]))
        topics[lengths("topics"), np.arange(len(lengths("topics"))) % q.topics.shape[1]] = values("topics")
        found.append((q.weights[2], q.topics @ topics.T))
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, DOCUMENTS):
            yield pa.concat_batches([batch.slice(i, DOCUMENTS)])


def _moments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            sums = np.stack([np.stack([np.full(len(x), x.shape[1]), x.sum(1), (x * x).sum(1)]) for _, x in _products(shared.value, batch)])
            total = sums if total is None else total + sums
        if total is not None:
            scorer, question = (a.ravel() for a in np.indices((total.shape[0], total.shape[2])))
            yield pa.RecordBatch.from_arrays([pa.array(scorer), pa.array(question), *[pa.array(total[:, i].ravel()) for i in range(3)]], ["scorer", "question", "n", "s", "ss"])

    return run


def _best(shared, mean: np.ndarray, sd: np.ndarray, k: int, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            order = batch.column(0).to_pandas().sort_values(kind="stable").index.to_numpy()
            total = sum(w * (x - mean[i][:, None]) / sd[i][:, None] for i, (w, x) in enumerate(_products(shared.value, batch)))[:, order]
            best = np.argsort(-(total if digits is None else np.round(total, digits)), axis=1, kind="stable")[:, :k]
            ids = batch.column(0).take(pa.array(order[best].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(total)), best.shape[1])), ids, pa.array(np.take_along_axis(total, best, 1).ravel())], ["question", "doc_id", "score"])

    return run


def zscore_top_k(questions: Questions, docs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): the exact top k of one block over all documents.

    ``docs`` has doc_id, numbers (with places, if sparse), topics, and asked and
    matched (the block's questions that share words with it, and their BM25); or
    it is made by ``features.rows``.
    Ties go to the smaller id; with ``digits``, scores that are equal when rounded
    to so many places tie, as copies of a text do whose sums were made in another order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(questions)
    rows = docs.mapInArrow(_moments(shared), "scorer long, question long, n double, s double, ss double").groupBy("scorer", "question").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()  # scorers x questions rows
    size = (3, len(questions.ids))
    mean, sd = np.zeros(size), np.ones(size)
    for r in rows:
        m = r["s"] / r["n"]
        deviation = np.sqrt(max(r["ss"] / r["n"] - m * m, 0.0))
        mean[r["scorer"], r["question"]], sd[r["scorer"], r["question"]] = m, 1.0 if deviation < LEAST_SD else deviation
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_best(shared, mean, sd, k, digits), f"question long, doc_id {kind}, score double")
    names = F.broadcast(spark.createDataFrame(list(enumerate(questions.ids)), ["question", "qid"]))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score" if digits is None else F.round("score", digits)), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "question").select("qid", "rank", "doc_id", "score")
