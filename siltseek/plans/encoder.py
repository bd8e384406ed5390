"""The retriever behind the interface of a retrieval benchmark's harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltseek.plans.retriever import CodeIndex, HybridRetriever
from siltseek.sources import harness


class HarnessEncoder:
    """encode, index and search over the harness's tables."""

    def __init__(self, retriever: HybridRetriever) -> None:
        self.retriever = retriever
        self._index: CodeIndex | None = None

    def encode(self, df: DataFrame, query: bool = False) -> DataFrame:
        """Vectors of (id, text); of a question the full view alone."""
        if query:
            views = self.retriever.query_texts(df.withColumnRenamed("id", "qid"))
            return self.retriever.embedder.embed(views.select(F.col("qid").alias("id"), F.col("full").alias("text")), "query_full")
        return self.retriever.embedder.embed(self.retriever.document_texts(df.withColumnRenamed("id", "doc_id")), "doc")

    def index(self, corpus: DataFrame) -> CodeIndex:
        self._index = self.retriever.build_index(harness.corpus(corpus))
        return self._index

    def search(self, queries: DataFrame, top_k: int = 100, top_ranked: DataFrame | None = None, prefilter: bool = False) -> DataFrame:
        """(qid, rank, doc_id, score). ``top_ranked`` (qid, doc_id) keeps a query's listed documents.

        The list applies after the top k, as harnesses expect, or before it with
        ``prefilter``; a query without a list keeps all.
        """
        if self._index is None:
            raise ValueError("index() comes before search()")
        asked = harness.queries(queries)
        k = self._index.docs.count() if top_ranked is not None and prefilter else top_k
        run = self.retriever.search(self._index, asked, k)
        if top_ranked is None:
            return run
        listed = top_ranked.select("qid").distinct().withColumn("_listed", F.lit(True))
        allowed = top_ranked.select("qid", "doc_id").distinct().withColumn("_allowed", F.lit(True))
        kept = run.join(listed, "qid", "left").join(allowed, ["qid", "doc_id"], "left").where("_listed IS NULL OR _allowed IS NOT NULL")
        kept = kept.select("qid", "rank", "doc_id", "score")
        if prefilter:
            from siltseek.operators.fusion import top_k as best

            kept = best(kept.drop("rank"), top_k).select("qid", "rank", "doc_id", "score")
        return kept
