"""Snippets across versions: dedupe, holders, statistics and grouped hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siltseek.functions import text as T


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content_hash", T.content_hash("text"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Each (sid, content_hash) once, with the text of its first version."""
    first = F.row_number().over(W.partitionBy("sid", "content_hash").orderBy("version_seq"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def holders(rows: DataFrame) -> DataFrame:
    """(sid, content_hash, same_in_versions, newest, newest_location): versions in order."""
    packed = F.array_sort(F.collect_list(F.struct("version_seq", "version", "location")))
    grouped = rows.groupBy("sid", "content_hash").agg(packed.alias("v"))
    last = F.element_at("v", -1)
    return grouped.select("sid", "content_hash", F.transform("v", lambda x: x["version"]).alias("same_in_versions"), last["version"].alias("newest"), last["location"].alias("newest_location"))


def version_stats(rows: DataFrame, key: str) -> DataFrame:
    """(version_seq, version, snippets, new_or_changed, unchanged) of versions in order.

    New are the distinct keys (of what is encoded) that no earlier version had;
    ``key`` names their column.
    """
    first = rows.groupBy(key).agg(F.min("version_seq").alias("version_seq"))
    new = first.groupBy("version_seq").agg(F.count(F.lit(1)).alias("new_or_changed"))
    every = rows.groupBy("version_seq", "version").agg(F.count(F.lit(1)).alias("snippets"))
    n = F.coalesce("new_or_changed", F.lit(0))
    return every.join(new, "version_seq", "left").select("version_seq", "version", "snippets", n.alias("new_or_changed"), F.greatest(F.col("snippets") - n, F.lit(0)).alias("unchanged"))


def grouped_hits(scored: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """One hit per snippet: its best text, where that is, and its other texts.

    ``scored`` is (qid, sid, content_hash, score, text). The newest holder of a
    text names its version and location; ``changed_in_versions`` has one entry a
    differing text, best first.
    """
    joined = scored.join(holders(rows), ["sid", "content_hash"])
    entry = F.struct((-F.col("score")).alias("order"), "content_hash", "score", "newest", "newest_location", "same_in_versions", "text")
    grouped = joined.groupBy("qid", "sid").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    best = F.element_at("e", 1)
    others = F.transform(F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))), lambda x: F.struct(x["newest"].alias("version"), x["score"].alias("score")))
    hits = grouped.select("qid", F.col("sid").alias("id"), best["score"].alias("score"), best["newest"].alias("version"), best["text"].alias("text"), best["newest_location"].alias("location"), best["same_in_versions"].alias("same_in_versions"), others.alias("changed_in_versions"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
