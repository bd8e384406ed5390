"""Dense vectors: encoders, the cache of their results, and similarity."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siltseek.functions import text as T
from siltseek.functions.lexicon import PRESETS
from siltseek.functions.topics import dot, norm
from siltseek.operators.sizing import broadcast_if_small


class Embedder(Protocol):
    """An encoder: (id, text) to (id, vector)."""

    name: str

    def embed(self, df: DataFrame, kind: str) -> DataFrame: ...


def l2(vector: Column) -> Column:
    """The vector at length 1; a vector of zeros stays."""
    n = norm(vector)
    return F.transform(vector, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


class HashingEmbedder:
    """Signed feature hashing of code words and adjacent pairs, as sparse rows.

    ``embed`` gives (id, bucket, value): bucket = crc32 % dim, sign by bit 16,
    sign(x) ln(1 + |x|), length 1. A text without terms has no rows. The vector
    is never spread out to ``dim`` numbers.
    """

    def __init__(self, dim: int = 1024) -> None:
        self.dim, self.name = dim, f"hashing-{dim}"

    def embed(self, df: DataFrame, kind: str) -> DataFrame:
        terms = df.select("id", T.code_terms("text").alias("t"))
        tail = F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))
        head = F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))
        pairs = F.zip_with(head, tail, lambda a, b: F.concat_ws("_", a, b))
        grams = terms.select("id", F.explode(F.concat("t", pairs)).alias("g")).withColumn("h", F.crc32("g"))
        sign = F.when(F.shiftright("h", 16).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        sums = grams.groupBy("id", (F.col("h") % self.dim).alias("bucket")).agg(F.sum(sign).alias("x")).where("x <> 0")
        damped = sums.select("id", "bucket", (F.signum("x") * F.log1p(F.abs("x"))).alias("y"))
        length = F.sqrt(F.sum(F.col("y") * F.col("y")).over(W.partitionBy("id")))
        return damped.select("id", "bucket", (F.col("y") / length).alias("value"))


class ColumnEmbedder:
    """Vectors that a table already has."""

    def __init__(self, vectors: DataFrame, name: str = "column") -> None:
        self.vectors, self.name = vectors, name

    def embed(self, df: DataFrame, kind: str) -> DataFrame:
        return df.select("id").join(self.vectors, "id")


class SentenceTransformerEmbedder:
    """A transformer encoder; needs a package and model files that must be at hand on every worker."""

    def __init__(self, model_name: str, max_seq_length: int = 512, query_prefix: str = "", doc_prefix: str = "", trust_remote_code: bool = False, batch_size: int = 32) -> None:
        self.name, self.max_seq_length, self.batch_size = model_name, max_seq_length, batch_size
        self.query_prefix, self.doc_prefix, self.trust_remote_code = query_prefix, doc_prefix, trust_remote_code

    def embed(self, df: DataFrame, kind: str) -> DataFrame:
        name, longest, trust, size = self.name, self.max_seq_length, self.trust_remote_code, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name, device="cpu", trust_remote_code=trust)
            if longest:
                model.max_seq_length = longest
            for batch in batches:
                vectors = model.encode(batch.column(1).to_pylist(), batch_size=size, normalize_embeddings=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], ["id", "vector"])

        prefixed = df.select(F.col("id").cast("string").alias("id"), T.prefixed("text", kind, self.query_prefix, self.doc_prefix).alias("text"))
        return prefixed.mapInArrow(run, "id string, vector array<float>")


def build_embedder(preset: str, **overrides) -> Embedder:
    """An encoder from a preset's name or a model id; null overrides are ignored."""
    settings = PRESETS.get(preset, {"model_name": preset}) | {k: v for k, v in overrides.items() if v is not None}
    return HashingEmbedder() if settings["model_name"] == "hashing" else SentenceTransformerEmbedder(**settings)


class EmbeddingCache:
    """Vectors by content key in a Parquet folder that only grows; a key fixes its value."""

    def __init__(self, spark: SparkSession, path: str, value: str = "vector array<float>") -> None:
        self.spark, self.path, self.schema = spark, path, f"k string, {value}"

    def read(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """Each key of (k, text) that has no vector, once."""
        return keyed.dropDuplicates(["k"]).join(self.read().select("k"), "k", "left_anti")

    def put(self, rows: DataFrame) -> None:
        rows.join(self.read().select("k").distinct(), "k", "left_anti").write.mode("append").parquet(self.path)


def hit_counts(keyed: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: misses (distinct keys without a vector) and hits (all other rows)."""
    return keyed.agg(F.count(F.lit(1)).alias("n")).crossJoin(missing.agg(F.count(F.lit(1)).alias("misses"))).select("misses", (F.col("n") - F.col("misses")).alias("hits"))


class CachedEmbedder:
    """An encoder behind a cache: each text is encoded once, ever."""

    def __init__(self, embedder: Embedder, cache: EmbeddingCache) -> None:
        self.embedder, self.cache, self.name = embedder, cache, embedder.name
        self.dim = getattr(embedder, "dim", None)
        self.hits = self.misses = 0

    def embed(self, df: DataFrame, kind: str) -> DataFrame:
        keyed = df.select("id", "text", T.cache_key(self.name, kind, "text").alias("k"))
        todo = self.cache.missing(keyed.select("k", "text"))
        row = hit_counts(keyed, todo).first()
        self.hits, self.misses = self.hits + row["hits"], self.misses + row["misses"]
        if row["misses"]:
            encoded = self.embedder.embed(todo.select(F.col("k").alias("id"), "text"), kind).withColumnRenamed("id", "k")
            if "bucket" in encoded.columns:
                encoded = todo.select("k").join(encoded.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("vector")), "k", "left")
            self.cache.put(encoded)
        found = keyed.select("id", "k").join(self.cache.read(), "k").drop("k")
        if found.schema["vector"].dataType.typeName() == "map":  # sparse vectors are kept as one row a text
            return found.select("id", F.explode("vector").alias("bucket", "value"))
        return found


def build_cached(spark: SparkSession, preset: str, path: str, **overrides) -> CachedEmbedder:
    """An encoder with its cache in a Parquet folder."""
    embedder = build_embedder(preset, **overrides)
    sparse = isinstance(embedder, HashingEmbedder)
    return CachedEmbedder(embedder, EmbeddingCache(spark, path, "vector map<bigint,double>" if sparse else "vector array<float>"))


def pair_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, dense) of all pairs of (qid, vector) and (doc_id, vector), in codegen-free JVM code."""
    q = queries.select("qid", F.col("vector").alias("_q"))
    return docs.crossJoin(broadcast_if_small(q)).select("qid", "doc_id", dot(F.col("_q"), F.col("vector")).alias("dense"))


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, dense) of (id, bucket, value) rows that share a bucket; all others score 0."""
    q = queries.select(F.col("id").alias("qid"), "bucket", F.col("value").alias("_q"))
    d = docs.select(F.col("id").alias("doc_id"), "bucket", "value")
    return d.join(broadcast_if_small(q), "bucket").groupBy("qid", "doc_id").agg(F.sum(F.col("_q") * F.col("value")).alias("dense"))


def _query_blocks(queries: DataFrame, limit: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of at most ``limit`` questions at a time, by id."""
    rows = queries.select("qid", "vector").orderBy("qid").toLocalIterator()
    while block := list(itertools.islice(rows, limit)):
        yield [r["qid"] for r in block], np.array([r["vector"] for r in block], np.float64)


def _united(parts: Iterator[DataFrame], queries: DataFrame, schema: str) -> DataFrame:
    """The results of all blocks; with no questions, none."""
    found = list(parts)
    return reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, {schema}")


def block_moments(queries: DataFrame, docs: DataFrame, limit: int = 4096) -> DataFrame:
    """(qid, n, mean, sd) of the dense scores of questions over all documents, ``limit`` questions at a time.

    Each batch of documents is one matrix product a block and sends one row a
    question, never a row a pair.
    """
    return _united((_moments(*block, docs) for block in _query_blocks(queries, limit)), queries, "n long, mean double, sd double")


def _moments(qids: list, matrix: np.ndarray, docs: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = shared.value @ np.array(batch.column(0).to_pylist(), np.float64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(np.full(len(x), x.shape[1])), pa.array(x.sum(1)), pa.array((x * x).sum(1))], ["q", "n", "s", "ss"])

    sums = docs.select("vector").mapInArrow(run, "q long, n long, s double, ss double").groupBy("q").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    names = docs.sparkSession.createDataFrame(list(enumerate(qids)), ["q", "qid"])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.join(F.broadcast(names), "q").select("qid", "n", mean.alias("mean"), sd.alias("sd"))


def block_topk(queries: DataFrame, docs: DataFrame, k: int, limit: int = 4096) -> DataFrame:
    """(qid, rank, doc_id, dense): exact top k of questions over all documents, ``limit`` questions at a time.

    Each batch of documents is one matrix product a block and keeps its k best a
    question; ties go to the smaller id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _united((_topk(*block, docs, k) for block in _query_blocks(queries, limit)), queries, f"rank int, doc_id {kind}, dense double")


def _topk(qids: list, matrix: np.ndarray, docs: DataFrame, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = batch.column(0).to_pandas().sort_values().index.to_numpy()
            vectors = np.array(batch.column(1).to_pylist(), np.float64)[order]
            x = shared.value @ vectors.T
            best = np.argsort(-x, axis=1, kind="stable")[:, :k]
            at = order[best].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), best.shape[1])), batch.column(0).take(pa.array(at)), pa.array(np.take_along_axis(x, best, 1).ravel())], ["q", "doc_id", "dense"])

    found = docs.select("doc_id", "vector").mapInArrow(run, f"q long, doc_id {kind}, dense double")
    names = docs.sparkSession.createDataFrame(list(enumerate(qids)), ["q", "qid"])
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("dense"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("qid", "rank", "doc_id", "dense")
