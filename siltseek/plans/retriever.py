"""The hybrid retriever: index and search as plans over tables."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltseek.functions import text as T, topics
from siltseek.functions.lexicon import TOPIC_NAMES
from siltseek.operators import blocks, dense, features, fusion, lexical
from siltseek.operators.sizing import over_all_cores
from siltseek.sources.config import PipelineConfig

_PARTS = ("docs", "vectors", "postings", "stats", "topics")


@dataclass
class CodeIndex:
    """docs (doc_id, text), vectors (sparse: id, bucket, value; or id, vector), postings, stats, topics."""

    docs: DataFrame
    vectors: DataFrame
    postings: DataFrame
    stats: DataFrame
    topics: DataFrame
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees what ``build_index`` keeps in memory or on disk; the index still works."""
        for df in self.kept:
            df.unpersist()

    def save(self, path: str) -> None:
        """Tables below ``path``; postings lie together by term for the search's join."""
        for part in _PARTS:
            df = getattr(self, part)
            if part == "postings":
                df = df.repartitionByRange("term").sortWithinPartitions("term")
            df.write.mode("overwrite").parquet(f"{path}/{part}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in _PARTS])


class HybridRetriever:
    """Dense, BM25 and topic scores over all documents, fused to a top k.

    Documents are (doc_id, text), questions (qid, text). Ties go to the smaller
    document id. An empty corpus or no questions give an empty result.
    """

    def __init__(self, config: PipelineConfig | None = None, embedder: dense.Embedder | None = None) -> None:
        self.config = config or PipelineConfig()
        self.embedder = embedder or dense.build_embedder(self.config.model, max_seq_length=self.config.max_seq_length)

    def _encoded(self) -> Column:
        """The column text as the encoder sees it."""
        body = T.clean_code("text", self.config.doc_max_chars)
        if self.config.augment_tags:
            body = topics.tagged_document(body, topics.top_tags(topics.code_topics(F.col("text"))))
        return body

    def document_texts(self, docs: DataFrame) -> DataFrame:
        """(id, text) as the encoder sees them."""
        return docs.select(F.col("doc_id").alias("id"), self._encoded().alias("text"))

    def query_texts(self, queries: DataFrame, *more: Column) -> DataFrame:
        """(qid, full, statement), and ``more`` of the questions; the statement is null where it is the full view."""
        views = queries.select("qid", "text", T.query_views("text").alias("v")).select("qid", "text", F.col("v.full").alias("full"), F.col("v.statement").alias("statement"))
        if self.config.augment_tags:
            tags = topics.top_tags(topics.query_topics(F.col("text")))
            views = views.select("qid", "text", *[topics.tagged_query(F.col(c), tags).alias(c) for c in ("full", "statement")])
        return views.select("qid", "full", F.when(F.col("statement") != F.col("full"), F.col("statement")).alias("statement"), *more)

    def build_index(self, docs: DataFrame) -> CodeIndex:
        cfg, docs = self.config, over_all_cores(docs)
        terms = docs.select("doc_id", T.code_terms("text").alias("terms")).persist()
        built = lexical.build(terms, cfg.bm25_k1, cfg.bm25_b)
        tagged = docs.select("doc_id", topics.code_topics(F.col("text")).alias("topics"))
        vectors = self.embedder.embed(self.document_texts(docs), "doc")
        return CodeIndex(docs.select("doc_id", "text"), vectors.persist(), built.postings.persist(), built.stats, tagged, [terms, vectors, built.postings])

    def _query_vectors(self, views: DataFrame) -> DataFrame:
        """One vector a question: both views' vectors, weighted (a dot product is linear)."""
        cfg = self.config
        full = self.embedder.embed(views.select(F.col("qid").alias("id"), F.col("full").alias("text")), "query_full")
        stmt_rows = views.where("statement IS NOT NULL").select(F.col("qid").alias("id"), F.col("statement").alias("text"))
        stmt = self.embedder.embed(stmt_rows, "query_stmt")
        both = stmt_rows.select("id").withColumn("two", F.lit(True))
        weighted = full.join(both, "id", "left").withColumn("w", F.when(F.col("two"), cfg.w_full).otherwise(1.0)).drop("two").unionByName(stmt.withColumn("w", F.lit(cfg.w_stmt)))
        if "bucket" in full.columns:
            return weighted.groupBy("id", "bucket").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        return weighted.select("id", F.transform("vector", lambda x: x * F.col("w")).alias("v")).groupBy("id").agg(F.reduce(F.collect_list("v"), F.array().cast("array<double>"), lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))).alias("vector"))

    def scorers(self, index: CodeIndex, queries: DataFrame) -> dict[str, tuple[DataFrame, float]]:
        """name -> ((qid, doc_id, score) of pairs that match, weight); weight 0 has no plan."""
        cfg, views = self.config, self.query_texts(queries)
        q = self._query_vectors(views)
        if "bucket" in index.vectors.columns:
            near = dense.sparse_scores(q, index.vectors)
        else:
            near = dense.pair_scores(q.withColumnRenamed("id", "qid"), index.vectors.withColumnRenamed("id", "doc_id"))
        found = {"dense": (near.withColumnRenamed("dense", "score"), 1.0)}
        if cfg.bm25_weight:
            full = queries.select("qid", T.query_terms(T.query_views("text")["full"]).alias("terms"))
            bm25 = lexical.scores(lexical.LexicalIndex(index.postings, index.stats), full)
            found["bm25"] = (bm25.withColumnRenamed("bm25", "score"), cfg.bm25_weight)
        if cfg.topic_weight:
            unit = lambda df, id_, vec: df.select(F.col(id_), F.posexplode(dense.l2(vec)).alias("topic", "x")).where("x <> 0")
            qt = unit(queries.select("qid", topics.query_topics(F.col("text")).alias("t")), "qid", F.col("t")).withColumnRenamed("x", "y")
            dt = unit(index.topics, "doc_id", F.col("topics"))
            found["topic"] = (dt.join(lexical.broadcast_if_small(qt), "topic").groupBy("qid", "doc_id").agg(F.sum(F.col("x") * F.col("y")).alias("score")), cfg.topic_weight)
        return found

    def all_scores(self, index: CodeIndex, queries: DataFrame) -> DataFrame:
        """(qid, doc_id, dense, bm25, topic) with a row for every pair; for reciprocal ranks and grids."""
        pairs = index.docs.select("doc_id").crossJoin(lexical.broadcast_if_small(queries.select("qid")))
        for name, (df, _) in self.scorers(index, queries).items():
            pairs = pairs.join(df.withColumnRenamed("score", name), ["qid", "doc_id"], "left").fillna(0.0, [name])
        for name in ("bm25", "topic"):
            pairs = pairs if name in pairs.columns else pairs.withColumn(name, F.lit(0.0))
        return pairs

    def _blocks(self, index: CodeIndex, queries: DataFrame) -> Iterator[tuple[blocks.Questions, DataFrame]]:
        """Blocks of questions with the documents' rows for them; the driver holds one block at a time."""
        cfg, sparse = self.config, "bucket" in index.vectors.columns
        packed = F.collect_list(F.struct("bucket", "value"))
        docs = index.docs.select("doc_id")
        if sparse:
            entry = F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), "value")))
            own = index.vectors.groupBy("id").agg(entry.alias("v")).select(F.col("id").alias("doc_id"), F.col("v.bucket").alias("places"), F.col("v.value").alias("numbers"))
        else:
            own = index.vectors.select(F.col("id").alias("doc_id"), F.transform("vector", lambda x: x.cast("double")).alias("numbers"))
        docs = docs.join(own, "doc_id", "left")
        if cfg.topic_weight:
            docs = docs.join(index.topics.select("doc_id", dense.l2(F.col("topics")).alias("topics")), "doc_id", "left")
        ids = queries.select("qid").distinct().orderBy("qid").toLocalIterator()
        while part := [r["qid"] for r in itertools.islice(ids, blocks.QUESTIONS)]:
            numbered = F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(part)), ["q", "qid"]))  # a block of questions
            block = queries.join(numbered, "qid")
            vectors = self._query_vectors(self.query_texts(block))
            vectors = vectors.groupBy("id").agg(packed.alias("v")) if sparse else vectors.select("id", F.col("vector").alias("v"))
            asked = {r["id"]: r["v"] for r in vectors.collect()}
            tags = {r["qid"]: r["t"] for r in block.select("qid", topics.query_topics(F.col("text")).alias("t")).collect()}
            width = getattr(self.embedder, "dim", None) or max((len(v) for v in asked.values()), default=1)
            matrix, tagged = np.zeros((len(part), width)), np.zeros((len(part), len(TOPIC_NAMES)))
            for row, qid in enumerate(part):
                for j, x in [(e["bucket"], e["value"]) for e in asked.get(qid, [])] if sparse else enumerate(asked.get(qid, [])):
                    matrix[row, j] = x
                length = np.linalg.norm(tags[qid])
                tagged[row] = np.array(tags[qid]) / (length or 1)
            rows = docs
            if cfg.bm25_weight:
                terms = block.select(F.col("q").alias("qid"), T.query_terms(T.query_views("text")["full"]).alias("terms"))
                words = lexical.scores(lexical.LexicalIndex(index.postings, index.stats), terms)
                entry = F.collect_list(F.struct("qid", "bm25"))
                rows = docs.join(words.groupBy("doc_id").agg(entry.alias("m")).select("doc_id", F.col("m.qid").alias("asked"), F.col("m.bm25").alias("matched")), "doc_id", "left")
            rows = rows.persist()  # read by both passes
            index.kept.append(rows)
            yield blocks.Questions(part, matrix, tagged, (1.0, cfg.bm25_weight, cfg.topic_weight)), rows

    def search(self, index: CodeIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, rank, doc_id, score), best first."""
        cfg = self.config
        if cfg.fusion != "rrf":
            return self._best(self._blocks(index, queries), index.docs, queries, top_k)
        weights = {"dense": 1.0, "bm25": cfg.bm25_weight, "topic": cfg.topic_weight}
        ranked = fusion.rank_scored(self.all_scores(index, queries), [c for c, w in weights.items() if w], cfg.rrf_k)
        scored = ranked.select("qid", "doc_id", fusion.weighted({f"r_{c}": w for c, w in weights.items()}).alias("score"))
        return fusion.top_k(scored, top_k).select("qid", "rank", "doc_id", "score")

    def _once(self, docs: DataFrame, queries: DataFrame) -> Iterator[tuple[blocks.Questions, DataFrame]]:
        """Blocks of questions with the documents' rows for them, each by one pass over the texts."""
        cfg = self.config
        # cleaning changes no term of a text that is not cut, unless a CR alone ends a line of it
        whole = (F.length(F.replace(F.col("text"), F.lit("\t"), F.lit("    "))) <= cfg.doc_max_chars) & ~F.regexp_like("text", F.lit("\r(?!\n)"))
        encoded = F.when(F.lit(not cfg.augment_tags) & F.coalesce(whole, F.lit(True)), None).otherwise(self._encoded())
        bag = T.query_terms(T.query_views("text")["full"])
        asked = self.query_texts(queries.orderBy("qid"), topics.query_topics(F.col("text")).alias("topics"), bag.alias("terms"))
        ids = ((qid, list(rows)) for qid, rows in itertools.groupby(asked.toLocalIterator(), lambda r: r["qid"]))
        while part := list(itertools.islice(ids, blocks.ASKED)):
            full = features.hashed_vectors([[r["full"] for r in rows] for _, rows in part], self.embedder.dim)
            statement = features.hashed_vectors([[r["statement"] for r in rows if r["statement"] is not None] for _, rows in part], self.embedder.dim)
            two = np.array([[any(r["statement"] is not None for r in rows)] for _, rows in part])
            tagged = np.array([rows[-1]["topics"] for _, rows in part])
            length = np.linalg.norm(tagged, axis=1, keepdims=True)
            block = blocks.Questions([qid for qid, _ in part], np.where(two, cfg.w_full, 1.0) * full + cfg.w_stmt * statement, tagged / np.where(length == 0, 1, length), (1.0, cfg.bm25_weight, cfg.topic_weight))
            bags = [Counter(t for r in rows for t in r["terms"]) if cfg.bm25_weight else Counter() for _, rows in part]
            terms = sorted(set().union(*bags))
            found = features.rows(docs, terms, self.embedder.dim, bool(cfg.topic_weight), encoded).persist()  # read by three passes
            if cfg.bm25_weight:
                df, n, mean = features.statistics(found, len(terms))
                number = {t: i for i, t in enumerate(terms)}
                own = sorted((number[t], q, 1 + np.log(times)) for q, bag in enumerate(bags) for t, times in bag.items())
                count = np.bincount(np.array([t for t, _, _ in own], np.int64), minlength=len(terms))
                idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
                block.words = blocks.Words(np.cumsum(count) - count, count, np.array([q for _, q, _ in own], np.int64), np.array([w for _, _, w in own], float), idf, mean, cfg.bm25_k1, cfg.bm25_b)
            yield block, found

    def search_texts(self, docs: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """What ``search`` finds in ``build_index(docs)``, for a search that keeps no index.

        With the hashing encoder and standardised sums, each document is one row
        from its text to its scores: no row a term, bucket or pair exists, and
        nothing but the best lists is shuffled.
        """
        if self.config.fusion == "rrf" or not isinstance(self.embedder, dense.HashingEmbedder):
            return self.search(self.build_index(docs), queries, top_k)
        return self._best(self._once(over_all_cores(docs), queries), docs, queries, top_k)

    def _best(self, found: Iterator[tuple[blocks.Questions, DataFrame]], docs: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
        """All blocks' best, ranked by scores rounded to 9 places, so that copies of a text tie."""
        parts = [blocks.zscore_top_k(block, rows, top_k, 9) for block, rows in found]
        return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
