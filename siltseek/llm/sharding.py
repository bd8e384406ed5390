"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts must share a shard. Best-fit-decreasing only looks at
sizes, so the driver gets the histogram (group size -> number of groups), whose
length is at most the square root of twice the total size. While an item of one
size fits its bin, that bin stays the tightest, so a whole run of equal sizes is
placed at once and the plan is exactly that of best-fit-decreasing over all
groups. The plan is a table of (size, first rank, last rank, shard); groups find
their shard by their rank among the groups of their size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltseek.llm.ranking import gapless
from siltseek.llm.scratch import scratch, spread_join

Run = tuple[int, int, int]  # size, number of items, bin
#: Groups of one size are dealt by stretches of so many ranks.
STRETCH = 100_000


class BinTree:
    """Bins by remaining room; the tightest that fits is found in O(log n).

    A treap keyed by (room, bin). Priorities come from a fixed generator, so the
    shape is the same in each run.
    """

    def __init__(self) -> None:
        self.root = None
        self._seed = 88172645463325252

    def _priority(self) -> int:
        x = self._seed
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._seed = x
        return x

    @staticmethod
    def _split(node, key):
        """Nodes below ``key`` and the rest; a node is [key, priority, left, right]."""
        low, high = [None] * 4, [None] * 4
        a, b = (low, 3), (high, 2)
        while node:
            if node[0] < key:
                a[0][a[1]] = node
                a, node = (node, 3), node[3]
            else:
                b[0][b[1]] = node
                b, node = (node, 2), node[2]
        a[0][a[1]] = b[0][b[1]] = None
        return low[3], high[2]

    @staticmethod
    def _join(a, b):
        top = [None] * 4
        at = (top, 2)
        while a and b:
            if a[1] > b[1]:
                at[0][at[1]] = a
                at, a = (a, 3), a[3]
            else:
                at[0][at[1]] = b
                at, b = (b, 2), b[2]
        at[0][at[1]] = a or b
        return top[2]

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        self.root = self._join(self._join(low, [(room, bin_), self._priority(), None, None]), high)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the smallest room of at least ``size``."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self.root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int, max_bins: int | None = None) -> list[Run] | None:
    """Best-fit-decreasing over (size, count), a new bin only when none fits.

    Returns runs (size, count, bin) in placing order, or None if more than
    ``max_bins`` bins would be needed. An item above ``capacity`` never fits.
    """
    tree, bins, plan = BinTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        if size > capacity:
            raise ValueError(f"an item of size {size} is above the capacity {capacity}")
        while count:
            found = tree.pop_tightest(size)
            if found is None:
                if max_bins is not None and bins >= max_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, bin_ = found
            placed = min(count, room // size) if size else count
            plan.append((size, placed, bin_))
            count -= placed
            if room - placed * size > 0:
                tree.add(room - placed * size, bin_)
    return plan


def balanced_plan(histogram: list[tuple[int, int]], shards: int) -> list[Run]:
    """The plan for exactly ``shards`` bins with the least capacity found.

    A group above the mean of what is left gets a shard of its own; the others
    share the rest under the smallest capacity (by bisection) for which
    best-fit-decreasing needs no more bins.
    """
    sizes = sorted(((s, n) for s, n in histogram if n), reverse=True)
    plan: list[Run] = []
    first = 0
    total = sum(s * n for s, n in sizes)
    while sizes and shards - first > 1 and sizes[0][0] * (shards - first) > total:
        size, n = sizes[0]
        plan.append((size, 1, first))
        first, total = first + 1, total - size
        sizes = ([(size, n - 1)] if n > 1 else []) + sizes[1:]
    if not sizes:
        return plan
    bins = shards - first
    low = max(-(-total // bins), sizes[0][0])
    step, best = max(1, low // 4096), None
    high = low
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        low, high, step = high + 1, high + step, step * 2
    while high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle, bins)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return plan + [(s, n, b + first) for s, n, b in best]


def plan_frame(spark: SparkSession, plan: list[Run]) -> DataFrame:
    """The plan as rows (p_size, p_from, p_to, shard); ranks of a size are half-open."""
    done: dict[int, int] = {}
    rows = []
    for size, n, bin_ in plan:
        at = done.get(size, 0)
        rows.append((size, at, at + n, bin_))
        done[size] = at + n
    return spark.createDataFrame(rows, "p_size long, p_from long, p_to long, shard int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus 1 (a null text: 1). Equal texts share a
    shard; shard sizes are near equal unless one group alone is larger. Null and
    empty texts have equal bytes and form one group. ``slot`` numbers a shard's
    rows from 0 without gaps. Repeated rows are placed one by one with their
    group; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"))
    rows = rows.select("doc_id", (F.octet_length("_t") + 1).cast("long").alias("size"), F.crc32("_t").cast("long").alias("text_crc32"), F.unhex(F.md5("_t")).alias("_g"))
    rows = scratch(rows, "sizes")
    groups = rows.groupBy("_g", "size").agg(F.count(F.lit(1)).alias("_copies"))
    groups = scratch(groups.select("_g", F.col("size").alias("_one"), (F.col("size") * F.col("_copies")).alias("p_size")), "groups")
    histogram = [(r["p_size"], r["n"]) for r in groups.groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    plan = plan_frame(spark, balanced_plan(histogram, shards))
    ranked = gapless(groups, ["p_size"], ["_g", "_one"], "_rank")
    # one size may hold a third of all groups: its ranks meet its runs by stretches of ``STRETCH``
    stretch = lambda c: F.expr(f"{c} div {STRETCH}")
    ranked = ranked.withColumn("_part", stretch("_rank"))
    plan = plan.withColumn("_part", F.explode(F.sequence(stretch("p_from"), stretch("(p_to - 1)"))))
    placed = ranked.join(plan, ["p_size", "_part"]).where("_rank >= p_from AND _rank < p_to").select("_g", F.col("_one").alias("size"), "shard")
    # copies of one text may be a third of all rows
    done = spread_join(rows, scratch(placed, "placed"), ["_g", "size"], "doc_id").select("doc_id", "size", "text_crc32", "shard")
    return gapless(done, ["shard"], ["doc_id", "text_crc32"], "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
