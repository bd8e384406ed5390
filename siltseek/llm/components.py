"""Connected components of a link table, in rounds of tasks (never on the driver)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from siltseek.llm import bytescan
from siltseek.llm.scratch import scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links contracted to (root, node); a root is the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[label[away]], nodes[away]


def dealt(a: np.ndarray, b: np.ndarray, tasks: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Links as one row per task that is to have them: (dest, a list, b list); a is the larger end."""
    a, b = np.maximum(a, b), np.minimum(a, b)
    dest = (bytescan.mixed(a.astype(np.int64).view(np.uint64)) % np.uint64(tasks)).astype(np.int32)
    by = np.argsort(dest, kind="stable")
    one, counts = np.unique(dest[by], return_counts=True)
    return pa.array(one, pa.int32()), *(bytescan.list_column(x[by], counts, pa.int64()) for x in (a, b))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: a task's links as a forest, (node, root) for each node but the roots."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        flat = lambda c: c.flatten() if pa.types.is_list(c.type) else c
        a, b = (np.concatenate([flat(p.column(i)).to_numpy() for p in parts]) for i in (0, 1))
        root, node = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


#: So many links (16 bytes each) are contracted by one task; more take rounds.
ONE_TASK = 1_000_000


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(a, b) links to (node, component), the component being its smallest node.

    Links may come packed by ``dealt`` (dest, a list, b list), which saves the
    first deal a row per link.

    A round deals the links by their larger end and contracts each task's links
    to a forest: a node that was given several roots links them there. Then every
    root that is itself a node hands its own root down. The forest that a round
    leaves unchanged gives each node one root that is nobody's node. Links are
    dealt by their nodes, not by their roots, so a component with a third of all
    nodes is spread over all tasks. Rounds grow with the logarithm of the longest
    path and each is cut off by a written table. A forest of at most ``one_task``
    links needs no more rounds: one task of bounded memory contracts what is
    left, with the same result. Nodes without a link do not appear.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = "dest" in edges.columns
    e = edges if packed else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    before = None
    for _ in range(max_rounds):
        state = Observation()
        e, packed = e.repartition(n, "dest" if packed else "a").select("a", "b"), False
        contracted = e.mapInArrow(_contract, "a long, b long")
        e = scratch(contracted.observe(state, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "forest")
        now = (state.get["n"], state.get["x"])
        if now == before or not now[0]:
            break
        before = now
        if now[0] <= one_task:
            e = scratch(e.coalesce(1).mapInArrow(_contract, "a long, b long"), "components")
            break
        settled = e
        above = settled.select(F.col("a").alias("b"), F.col("b").alias("above"))
        e = settled.join(above, "b", "left").select("a", F.coalesce("above", "b").alias("b"))
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
