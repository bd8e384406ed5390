"""The labelled documents a classifier learns from, as a bounded sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A null id, within a task; larger than any id.
LAST = (1 << 63) - 1


def held_out(id_: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32(id as text) modulo ``folds`` is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """(text, label) of at most ``per_class`` training documents of each class.

    The documents with the smallest hash of their id are taken, so the sample is
    a fixed function of the rows. Held-out rows, rows without a label of 0 or 1
    and rows without an id are not used. ``max_bytes`` bounds the sample's text:
    each class has half of it, and what one class leaves is the other's; a
    document that does not fit is left out, and later ones are still tried.
    A sample of one class is an error if the other's drawn texts are all too
    long; where none of them is among the documents it is a sample of one class.
    """
    id_ = F.col(id_col).cast("long")
    y = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    y = y.groupBy("_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("_id", F.lit(11))
    picked = y.where("label = 1").orderBy(order).limit(per_class).unionByName(y.where("label = 0").orderBy(order).limit(per_class))
    texts = docs.select(id_.alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most 2 x per_class ids of 16 bytes: a bounded broadcast
    found = texts.join(F.broadcast(picked), "_id").select("text", "label", order.alias("_o"), F.octet_length("text").cast("long").alias("_n"))
    table = found.where(F.col("_n") <= max_bytes).orderBy("_o", "text").toLocalIterator(prefetchPartitions=False)
    taken, spare, used, waiting = [], [], [0, 0], 0
    for i, r in enumerate(table):
        row = (i, r["text"], r["label"], r["_n"])
        if used[r["label"]] + r["_n"] <= max_bytes // 2:
            used[r["label"]] += r["_n"]
            taken.append(row)
        elif waiting + r["_n"] <= max_bytes:
            waiting += r["_n"]
            spare.append(row)
    total = sum(used)
    for row in spare:
        if total + row[3] <= max_bytes:
            total += row[3]
            taken.append(row)
    rows = [(t, y_) for _, t, y_, _ in sorted(taken)]
    kept = {y_ for _, y_ in rows}
    if len(kept) == 1 and found.where(F.col("label") == 1 - min(kept)).limit(1).count():
        raise ValueError(f"{label}: texts of class {1 - min(kept)} are among the documents, but none is within max_bytes={max_bytes}")
    return pa.table({"text": pa.array([t for t, _ in rows], pa.string()), "label": pa.array([y for _, y in rows], pa.int32())})


def training_share(labels: DataFrame, label: str) -> float:
    """The share of label 1 among all labelled training rows."""
    rows = labels.where(~held_out(F.col("doc_id").cast("long")) & F.col(label).isin(0, 1))
    row = rows.agg(F.avg(F.col(label).cast("double"))).first()
    return 0.0 if row[0] is None else float(row[0])
