"""Search in one version of a corpus, in the latest, or across all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siltseek.functions import text as T
from siltseek.operators import versions
from siltseek.plans.retriever import CodeIndex, HybridRetriever


class VersionedIndex:
    """Versions in the order they were added; ``snippets`` are (sid, text[, location])."""

    def __init__(self, retriever: HybridRetriever) -> None:
        self.retriever = retriever
        self.versions: dict[str, DataFrame] = {}
        self._indices: dict[tuple[str, str], CodeIndex] = {}

    def rows(self) -> DataFrame:
        """(version_seq, version, sid, text, location, content_hash) of all versions."""
        parts = [df.select(F.lit(i).alias("version_seq"), F.lit(v).alias("version"), "sid", "text", "location") for i, (v, df) in enumerate(self.versions.items())]
        return versions.with_hash(reduce(DataFrame.unionByName, parts))

    def add_version(self, version: str, snippets: DataFrame) -> dict:
        """Registers a version; returns its snippets, new_or_changed and unchanged counts.

        New is what would be encoded anew: distinct cleaned texts no version has had.
        """
        if "location" not in snippets.columns:
            snippets = snippets.withColumn("location", F.lit(""))
        self.versions[version] = snippets.select("sid", "text", "location")
        for key in [k for k in self._indices if k[0] == "all" or k[1] == version]:  # other versions' indices stay
            self._indices.pop(key).release()
        keyed = self.rows().withColumn("_k", F.sha1(T.clean_code("text", self.retriever.config.doc_max_chars)))
        row = versions.version_stats(keyed, "_k").where(F.col("version") == version).first()
        return {"version": version, "snippets": row["snippets"] if row else 0, "new_or_changed": row["new_or_changed"] if row else 0, "unchanged": row["unchanged"] if row else 0}

    def _index(self, key: tuple[str, str], docs: DataFrame) -> CodeIndex:
        if key not in self._indices:
            self._indices[key] = self.retriever.build_index(docs)
        return self._indices[key]

    def search(self, queries: DataFrame, version: str = "latest", top_k: int = 5, overfetch: int | None = None) -> DataFrame:
        """Hits (qid, rank, id, score, version, text, location, same_in_versions, changed_in_versions).

        ``version`` is a name, "latest" or "all". Across all versions equal texts
        of a snippet are one hit and its other texts are listed; every variant
        is ranked before grouping, or the best ``overfetch`` alone.
        """
        if not self.versions:
            raise ValueError("no version has been added")
        if version == "all":
            return self._search_all(queries, top_k, overfetch)
        version = list(self.versions)[-1] if version == "latest" else version
        docs = self.versions[version]
        index = self._index(("one", version), docs.select(F.col("sid").alias("doc_id"), "text"))
        run = self.retriever.search(index, queries, top_k)
        empty = F.array().cast("array<struct<version:string,score:double>>")
        joined = run.join(docs.withColumnRenamed("sid", "doc_id"), "doc_id")
        return joined.select("qid", "rank", F.col("doc_id").alias("id"), "score", F.lit(version).alias("version"), "text", "location", F.array().cast("array<string>").alias("same_in_versions"), empty.alias("changed_in_versions"))

    def _search_all(self, queries: DataFrame, top_k: int, overfetch: int | None) -> DataFrame:
        rows = self.rows()
        entries = versions.distinct_texts(rows).withColumn("doc_id", F.concat_ws("@", "sid", "content_hash"))
        index = self._index(("all", ""), entries.select("doc_id", "text"))
        run = self.retriever.search(index, queries, overfetch or max(1, entries.count()))
        scored = run.join(entries.select("doc_id", "sid", "content_hash", "text"), "doc_id")
        hits = versions.grouped_hits(scored.select("qid", "sid", "content_hash", "score", "text"), rows, top_k)
        return hits.select("qid", "rank", "id", "score", "version", "text", "location", "same_in_versions", "changed_in_versions")
