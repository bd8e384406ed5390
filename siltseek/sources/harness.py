"""Retrieval-benchmark tables: corpus, queries, relevance judgements; reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from siltseek.functions import text as T


def corpus(df: DataFrame) -> DataFrame:
    """(doc_id, text) from id, text and, where there is one, title."""
    body = T.with_title("title", "text") if "title" in df.columns else F.coalesce("text", F.lit(""))
    return df.select(F.col("id").cast("string").alias("doc_id"), body.alias("text"))


def queries(df: DataFrame) -> DataFrame:
    """(qid, text) from id, text and, where there is one, instruction."""
    body = T.with_instruction("text", "instruction") if "instruction" in df.columns else F.col("text")
    return df.select(F.col("id").cast("string").alias("qid"), body.alias("text"))


def qrels(df: DataFrame) -> DataFrame:
    """(qid, doc_id, grade) from query-id, corpus-id, score."""
    return df.select(F.col("query-id").cast("string").alias("qid"), F.col("corpus-id").cast("string").alias("doc_id"), F.col("score").cast("double").alias("grade"))


def texts_from_batches(df: DataFrame, col: str = "text") -> DataFrame:
    """One row per text of rows that hold lists of texts."""
    return df.select(F.explode(col).alias("text"))


def latest(versions: DataFrame) -> DataFrame:
    """The version that was registered last."""
    return versions.agg(F.max_by("version", "version_seq").alias("version"))


def parse_version_specs(specs: list[str]) -> list[tuple[str, str]]:
    """``name=path`` strings, oldest first."""
    return [(name, path) for name, _, path in (s.partition("=") for s in specs)]


def write_report(path: str | Path, report: dict | list) -> None:
    """A run's summary, a tuning report or a smoke report as JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2))
