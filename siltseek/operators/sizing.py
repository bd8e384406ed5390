"""Broadcasts only what a measurement has shown to be small; small scans use all cores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType

#: Rows, and bytes of values, of a side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.coalesce(F.octet_length(F.array_join(c, "--------")), F.lit(0)).cast("long")
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 16
    return F.lit(8).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``most`` bytes; at most ``rows`` + 1 rows are looked at."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= rows and seen["bytes"] <= most


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows, most) else df


def over_all_cores(scan: DataFrame) -> DataFrame:
    """A table read as fewer splits than there are cores is dealt over all of them; any other stays as it lies."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
