"""Row numbers within large classes without a task that holds a class.

A plain ``row_number() over (partition by class)`` puts a class in one task.
Here each class is dealt into cells by a hash of the row's id, the cells are
counted, and a running sum over the cell counts (classes x cells rows, not
documents) gives each cell its first number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def gapless(df: DataFrame, classes: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each combination of ``classes``.

    The numbers follow (cell, ``order``), so they are a fixed function of the
    rows. Rows that tie in every ordering column get distinct numbers.
    """
    cells = max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    dealt = df.withColumn("_cell", cell)
    counts = dealt.groupBy(*classes, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*classes).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_k_{c}") for c in classes], F.col("_cell").alias("_k_cell"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*classes, "_cell").orderBy(*order)) - 1
    numbered = dealt.withColumn("_inside", inside)
    same: Column = F.col("_cell") == F.col("_k_cell")
    for c in classes:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = numbered.join(starts, same, "inner")
    return joined.withColumn(out, (F.col("_start") + F.col("_inside")).cast("long")).drop("_cell", "_inside", "_start", "_k_cell", *[f"_k_{c}" for c in classes])
