"""A corpus pipeline of five stages, each one operator of ``siltseek.llm``.

Documents that the toxicity model rejects go; of exact copies and of near copies
one document stays; documents that hold a benchmark item go; the rest is packed
into sequences. ORACLE_SQL is None: SQL can express neither the classifier nor
the packing. Tests hold each stage against a brute-force version.

Each stage takes any columns beside doc_id and text, keeps them under their own
names (all but the last return all columns of its input), gives an empty result
for an empty table, and treats rows that repeat an id and text alike. What nulls,
empty texts and ties give is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltseek.llm import toxicity
from siltseek.llm.decontamination import drop_contaminated
from siltseek.llm.exact_dedup import drop_exact_duplicates
from siltseek.llm.near_dedup import drop_near_duplicates
from siltseek.llm.packing import pack_documents
from siltseek.llm.scratch import scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among ``docs``, then drops those scored 0.5 or more.

    Null and empty texts have the score of the bias alone, and stay where both
    classes were learnt from; without labels nothing is rejected.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the smallest id stays.

    Null and empty texts are equal; a null id stays only if its text has no other.
    """
    return drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) the smallest id stays.

    Null, empty and blank texts are like nothing and stay; a null id is larger
    than any id.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go.

    Null and empty texts hold none, and null or empty items are in none.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, in sequences of at most 2048 tokens.

    A null or empty text is one piece of its final id alone; a null id stays null.
    """
    return pack_documents(docs, 2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs, name)
    return docs
