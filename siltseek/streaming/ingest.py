"""Incremental ingest of a stream of snippets: only unseen texts are encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltseek.functions import text as T
from siltseek.operators.dense import CachedEmbedder


def ingest(stream: DataFrame, embedder: CachedEmbedder, checkpoint: str, kind: str = "doc", max_chars: int = 1800) -> StreamingQuery:
    """Runs each micro-batch of (id, text) through the cache until the input is used up.

    A replayed batch finds its texts in the cache, so a restart encodes nothing
    twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        embedder.embed(df.select("id", T.clean_code("text", max_chars).alias("text")), kind)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
