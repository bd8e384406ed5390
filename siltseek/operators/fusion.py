"""Scores of several scorers to one ranking: standardised sums, or reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siltseek.operators.sizing import broadcast_if_small

#: A standard deviation below this counts as 1.
LEAST_SD = 1e-6


def zscored(scores: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds z_<column>: each query's scores less their mean, by their population deviation.

    ``scores`` must hold every document of each query (0 where nothing matched).
    The moments are summed before any shuffle and joined, one row a query, so no
    task has to hold all documents of one.
    """
    by = by or ["qid"]
    moments = scores.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    out = scores.join(broadcast_if_small(moments), by)
    sd = lambda c: F.when(F.col(f"_sd_{c}") < LEAST_SD, 1.0).otherwise(F.col(f"_sd_{c}"))
    return out.select(*[F.col(c) for c in scores.columns], *[((F.col(c) - F.col(f"_mean_{c}")) / sd(c)).alias(f"z_{c}") for c in columns])


def rank_scored(scores: DataFrame, columns: list[str], k: int = 60, by: list[str] | None = None, tie: str = "doc_id") -> DataFrame:
    """Adds r_<column>: 1 / (k + rank), ranks from 1, ties by document."""
    out = scores
    for c in columns:
        rank = F.row_number().over(W.partitionBy(*(by or ["qid"])).orderBy(F.desc(c), tie))
        out = out.withColumn(f"r_{c}", 1.0 / (k + rank))
    return out


def weighted(columns: dict[str, float]) -> Column:
    """The weighted sum; a weight of 0 leaves its scorer out of the plan."""
    parts = [F.col(c) * w if w != 1 else F.col(c) for c, w in columns.items() if w]
    return reduce(lambda a, b: a + b, parts)


def blended(full: Column, statement: Column, w_full: float = 0.6, w_stmt: float = 0.4) -> Column:
    """Both views' scores, or the full view's alone where there is no other."""
    return F.when(statement.isNull(), full).otherwise(w_full * full + w_stmt * statement)


def top_k(scores: DataFrame, k: int, score: str = "score", by: list[str] | None = None, tie: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query with their rank; ties go to the smaller document id."""
    rank = F.row_number().over(W.partitionBy(*(by or ["qid"])).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def sparse_zscore_top_k(scorers: dict[str, tuple[DataFrame, float]], queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact top k by standardised sums without a row for every pair.

    ``scorers`` maps a name to ((qid, doc_id, score) of the pairs that match, weight);
    all other pairs score 0. Mean and deviation over all documents follow from
    the matches' sums and the number of documents. A pair's total is then a
    constant of its query plus what its matches add, so only pairs that match
    are rows; documents that match nothing are looked up for just those queries
    with fewer than ``k`` matches above the constant.
    """
    used = {name: s for name, s in scorers.items() if s[1]}
    long = reduce(DataFrame.unionByName, [df.select("qid", "doc_id", F.lit(name).alias("scorer"), F.col("score").cast("double").alias("s"), F.lit(float(w)).alias("w")) for name, (df, w) in used.items()])
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    sums = long.groupBy("qid", "scorer", "w").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2")).crossJoin(F.broadcast(total))
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    moments = sums.select("qid", "scorer", mean.alias("mean"), F.when(sd < LEAST_SD, 1.0).otherwise(sd).alias("sd"), "w")
    constant = moments.groupBy("qid").agg(F.sum(-F.col("w") * F.col("mean") / F.col("sd")).alias("base"))
    added = long.join(moments.select("qid", "scorer", "sd"), ["qid", "scorer"]).groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("s") / F.col("sd")).alias("added"))
    matched = added.join(constant, "qid").select("qid", "doc_id", (F.col("base") + F.col("added")).alias("score"), "added")
    enough = matched.where("added >= 0").groupBy("qid").agg(F.count(F.lit(1)).alias("m"))
    short = queries.select("qid").distinct().join(enough, "qid", "left").where(F.coalesce("m", F.lit(0)) < k).select("qid")
    rest = docs.select("doc_id").crossJoin(broadcast_if_small(short)).join(added.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").join(constant, "qid", "left")
    rest = top_k(rest.select("qid", "doc_id", F.coalesce("base", F.lit(0.0)).alias("score")), k).drop("rank")
    return top_k(matched.select("qid", "doc_id", "score").unionByName(rest), k).select("qid", "rank", "doc_id", "score")
