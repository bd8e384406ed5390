"""BM25 as tables: term counts, statistics, weights, and scores by a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siltseek.operators.sizing import broadcast_if_small, is_small


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of documents (doc_id, terms); dl counts terms with repeats."""
    exploded = docs.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return exploded.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl; documents without terms count, an average of 0 is 1."""
    mean = F.avg(F.size("terms"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, 1.0).otherwise(mean).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


@dataclass
class LexicalIndex:
    """postings (doc_id, term, tf, weight) and the one row of corpus statistics."""

    postings: DataFrame
    stats: DataFrame


def build(docs: DataFrame, k1: float = 1.2, b: float = 0.75, only: DataFrame | None = None) -> LexicalIndex:
    """Weights of all postings, or of the terms in ``only`` (term) alone.

    For a search that keeps no index, ``only`` holds the questions' terms, so
    that other postings are dropped before the first shuffle.
    """
    tf, few = term_frequencies(docs), False
    if only is not None:
        wanted = only.select("term").distinct()
        few = is_small(wanted)
        tf = docs.select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats, df = corpus_stats(docs), document_frequencies(tf)
    # few terms are asked for: their frequencies go to the postings, and a frequent term's postings stay where they are
    rows = tf.join(F.broadcast(df) if few else df, "term").crossJoin(F.broadcast(stats))  # stats is one row
    weight = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return LexicalIndex(rows.select("doc_id", "term", "tf", weight.alias("weight")), stats)


def query_weights(queries: DataFrame) -> DataFrame:
    """(qid, term, qw) of questions (qid, terms): 1 + ln(count)."""
    counted = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("qid", "term", (1 + F.log("n")).alias("qw"))


def scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, bm25) of the pairs that share a term; all others score 0."""
    joined = index.postings.join(broadcast_if_small(query_weights(queries)), "term")
    return joined.groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("bm25"))
