"""Whole runs over a judged collection: evaluation, tuning on a sample, a smoke report.

A collection is three tables in the harness's shape: corpus (id, text[, title]),
queries (id, text[, instruction]) and qrels (query-id, corpus-id, score).
"""

from __future__ import annotations

import os
import platform
import sys
import time
from dataclasses import asdict, dataclass, replace
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltseek.functions import text as T
from siltseek.operators import dense, metrics
from siltseek.plans.retriever import HybridRetriever
from siltseek.sources import harness
from siltseek.sources.config import PipelineConfig


@dataclass
class Collection:
    """docs (doc_id, text), queries (qid, text), qrels (qid, doc_id, grade)."""

    docs: DataFrame
    queries: DataFrame
    qrels: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, corpus: str, queries: str, qrels: str) -> Collection:
        """From Parquet, or JSON lines where a path ends in .json or .jsonl."""

        def table(path: str) -> DataFrame:
            return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)

        return cls(harness.corpus(table(corpus)), harness.queries(table(queries)), harness.qrels(table(qrels)))


def _seconds(began: float) -> float:
    return round(time.perf_counter() - began, 1)


def evaluate(data: Collection, config: PipelineConfig, embedder: dense.Embedder | None = None, k: int = 10) -> tuple[dict, DataFrame]:
    """(summary, run): index, search, and the quality of the best ``k``; no judged query gives metrics of null."""
    retriever, began = HybridRetriever(config, embedder), time.perf_counter()
    index = retriever.build_index(data.docs)
    n_docs = index.docs.count()
    for part in (index.vectors, index.postings):  # kept by the index; counting fills them
        part.count()
    index_s, start = _seconds(began), time.perf_counter()
    run = retriever.search(index, data.queries, k).persist()
    n_queries = data.queries.count()
    run.count()
    search_s = _seconds(start)
    row = metrics.mean_metrics(run, data.qrels, k).first()
    quality = {f"{name}_at_{k}": row[name] for name in ("ndcg", "mrr", "recall")}
    timings = {"wall_clock_seconds": _seconds(began), "index_seconds": index_s, "search_seconds": search_s}
    index.release()
    return quality | {"judged_queries": row["queries"]} | timings | {"docs": n_docs, "queries": n_queries, "cpu_count": os.cpu_count(), "config": asdict(config)}, run


def sampled(data: Collection, n_queries: int, n_docs: int, seed: int) -> Collection:
    """``n_queries`` judged queries, all their relevant documents and others up to ``n_docs``."""
    drawn, kept = metrics.sample_queries(data.queries, data.qrels, data.docs.select("doc_id"), n_queries, n_docs, seed)
    drawn = drawn.persist()
    return Collection(data.docs.join(kept, "doc_id", "left_semi").persist(), drawn, data.qrels.join(drawn.select("qid"), "qid", "left_semi").persist())


def tune(data: Collection, base: PipelineConfig, embedder: dense.Embedder | None = None, n_queries: int = 300, n_docs: int = 3000, seed: int = 7, tags: bool = False, k: int = 10) -> tuple[PipelineConfig, list[dict]]:
    """(best configuration, report): the grid's variants over real scores of a sample.

    Each variant searches the same index, with its view weights, so "full view"
    and "both views" differ where a question has two. The first of equals wins.
    ``tags`` also tries texts with topic tags, which need an index of their own.
    """
    part, rows, best = sampled(data, n_queries, n_docs, seed), [], None
    for tagged in (False, True) if tags else (False,):
        config = replace(base, augment_tags=tagged)
        index = HybridRetriever(config, embedder).build_index(part.docs)
        for v in metrics.default_grid():
            variant = replace(config, **{c: v[c] for c in ("fusion", "w_full", "w_stmt", "bm25_weight", "topic_weight")})
            run = HybridRetriever(variant, embedder).search(index, part.queries, k)
            row = metrics.mean_metrics(run, part.qrels, k).first()
            rows.append({"model": config.model, "tags": tagged, "variant": v["name"], f"ndcg_at_{k}": row["ndcg"], f"mrr_at_{k}": row["mrr"]})
            if best is None or (row["ndcg"] or 0.0) > best[0]:
                best = (row["ndcg"] or 0.0, variant)
        index.release()
    return best[1], rows


def _version(package: str) -> str | None:
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return None


def smoke(data: Collection, config: PipelineConfig, embedder: dense.Embedder | None = None, n: int = 48) -> dict:
    """What is installed, what the tables hold, how long ``n`` texts take to encode, and a search of 200 documents."""
    retriever = HybridRetriever(config, embedder)
    report: dict = {"python": sys.version.split()[0], "platform": platform.platform(), "versions": {p: _version(p) for p in ("pyspark", "pyarrow", "numpy", "pandas", "sentence-transformers")}}
    for name, df in (("doc", data.docs), ("query", data.queries)):
        row = metrics.length_profile(df).first()
        report |= {f"n_{'docs' if name == 'doc' else 'queries'}": row["n_rows"], f"{name}_chars_median_max": [row["median_chars"], row["max_chars"]]}
    docs, queries = data.docs.orderBy("doc_id"), data.queries.orderBy("qid")
    views = T.query_views("text")
    texts = {"doc": retriever.document_texts(docs.limit(n)), "query_full": queries.limit(n).select(F.col("qid").alias("id"), views["full"].alias("text"))}
    per = {}
    for kind, df in texts.items():
        df = df.persist()
        rows, began = max(1, df.count()), time.perf_counter()
        retriever.embedder.embed(df, kind).write.format("noop").mode("overwrite").save()
        per[kind] = (time.perf_counter() - began) / rows
    report |= {"seconds_per_doc": round(per["doc"], 4), "seconds_per_query_view": round(per["query_full"], 4)}
    report["estimated_full_run_minutes"] = round(metrics.runtime_minutes(report["n_docs"], report["n_queries"], per["doc"], per["query_full"]), 1)
    first = queries.limit(1)
    one = first.select("text", F.length(views["statement"]).alias("s"), F.length(views["full"]).alias("f")).first()
    if one:
        report |= {"sample_query_start": (one["text"] or "")[:500], "sample_query_views": {"statement_chars": one["s"], "full_chars": one["f"]}}
        hits = retriever.search(retriever.build_index(docs.limit(200)), first, 3).orderBy("rank").collect()
        report["tiny_search_top3"] = [[h["doc_id"], h["score"]] for h in hits]
    return report
