"""Written intermediate tables: lineage is cut by Parquet in the shared folder.

Executors may be lost at any time, so nothing an operator needs twice lives in
one executor's memory or on its disk. ``scratch`` writes a frame below the
folder that ``spark.checkpoint.dir`` names and reads it back; only where a local
session has no such folder (tests, a laptop) one is made and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that has none gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="siltseek-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


#: Whole texts and shingle sets are wide rows: a Python worker gets so many at a time.
ARROW_ROWS = 1000


def scratch(df: DataFrame, tag: str, at_a_time: int = ARROW_ROWS) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written files; a Python worker gets ``at_a_time`` rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltseek/{uuid.uuid4().hex}/{tag}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(at_a_time))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


#: A list of rows to drop is broadcast up to so many rows (of 50 bytes or so); a longer one is joined by a shuffle.
GONE_ROWS = 200_000


def drop_rows(df: DataFrame, gone: DataFrame, id_: Column, proof: Column, digest: Column) -> DataFrame:
    """``df`` without the rows named in ``gone`` (doc_id, proof, digest); all columns stay.

    A row is found by its id (without one, by ``proof``, a 64-bit hash of its
    text) and goes if its ``digest`` is the one named. Only the digests of rows
    found are computed.
    """
    name, proved = free_name(df, "gone_key"), free_name(df, "gone_digest")
    gone = scratch(gone, "gone").select(F.coalesce("doc_id", "proof").alias(name), F.col("digest").alias(proved))
    if gone.count() <= GONE_ROWS:
        gone = F.broadcast(gone)
    same = (F.coalesce(id_, proof) == F.col(name)) & F.nullif(digest, F.col(proved)).isNull()
    return df.join(gone, same, "left_anti")


def spread_join(df: DataFrame, other: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``other``, which has each of ``keys`` once; ``df`` is read twice.

    The rows of a key are dealt over as many cells as there are shuffle
    partitions, by a hash of ``by``, and ``other``'s row goes to the cells that
    want it: a key with a third of all rows is no task's alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    wanted = dealt.select(*keys, "_cell").distinct().join(other, keys)
    return dealt.join(wanted, [*keys, "_cell"], how).drop("_cell")
