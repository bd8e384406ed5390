"""Token counts: an exact length histogram and its suffix sums.

Documents are counted by encoded length; everything a context limit asks for
(documents that fit, tokens kept, tokens in all, quantiles) is a running sum
over the histogram. The histogram is summed in blocks, so no task holds it all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siltseek.llm import tokens
from siltseek.llm.scratch import scratch

_BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length.

    A null or empty text has length 0; every row counts, repeated ones too; an
    empty table gives an empty histogram; other columns are not read.
    """
    encoded = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tokens.lengths(vocabulary), "n_tokens long")
    return encoded.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


#: Limits that are asked about whatever lengths occur: the powers of two up to 1,048,576.
LIMITS = [1 << i for i in range(21)]


def context_limits(histogram: DataFrame, limits: list[int] | None = None) -> DataFrame:
    """For each occurring length, and each of ``limits``, as a context limit: counts, totals and quantile.

    context_limit, n_docs (of just that length), docs_within (no longer than the
    limit), docs_over, kept_tokens (total when texts are cut to the limit),
    total_tokens, quantile (docs_within / all documents). Any limit can be asked
    about: one that no document has is a length of no documents. An empty
    histogram gives an empty result.
    """
    if limits:
        more = histogram.sparkSession.createDataFrame([(n, 0) for n in set(limits)], "n_tokens long, n_docs long")
        histogram = histogram.unionByName(more).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = scratch(histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"), F.expr(f"n_tokens div {_BLOCK}").alias("_b")), "lengths")
    after = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_bn"), F.sum("_t").alias("_bt"))
    blocks = blocks.select("_b", F.coalesce(F.sum("_bn").over(after), F.lit(0)).alias("_an"), F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"))
    totals = h.agg(F.sum("n_docs").alias("_n"), F.sum("_t").alias("total_tokens"))
    inside = W.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    over = h.select("*", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("_in"), F.coalesce(F.sum("_t").over(inside), F.lit(0)).alias("_it"))
    rows = over.join(blocks, "_b").crossJoin(F.broadcast(totals.where("_n > 0")))  # totals is one row
    docs_over, tokens_over = F.col("_in") + F.col("_an"), F.col("_it") + F.col("_at")
    return rows.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("_n") - docs_over).alias("docs_within"),
        docs_over.alias("docs_over"),
        (F.col("total_tokens") - tokens_over + docs_over * F.col("n_tokens")).alias("kept_tokens"),
        "total_tokens",
        ((F.col("_n") - docs_over) / F.col("_n")).alias("quantile"),
    )


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), LIMITS)
