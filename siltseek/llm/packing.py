"""Best-fit packing: best-fit start, then swap-based local search.

How well lengths pack depends on the lengths alone, so the driver packs the
histogram of at most ``capacity`` lengths. A *class* is a set of bins with the
same contents and a multiplicity; best-fit-decreasing fills whole classes, and
the local search exchanges pieces between two underfull classes for as many
bins of each as there are. Pieces of one length are interchangeable: each class
slot is a range of ranks of its length, and a piece finds its sequence by its
rank.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import tokens
from siltseek.llm.ranking import gapless
from siltseek.llm.scratch import scratch


@dataclass
class BinClass:
    """``bins`` bins that all hold ``items``."""

    items: tuple[int, ...]
    bins: int
    fill: int = field(default=0)

    def __post_init__(self) -> None:
        self.fill = sum(self.items)


def best_fit_classes(counts: dict[int, int], capacity: int) -> list[BinClass]:
    """Best-fit-decreasing over length counts, whole classes of bins at a time."""
    by_room: dict[int, list[BinClass]] = {}

    def put(items: tuple[int, ...], bins: int) -> None:
        if bins:
            new = BinClass(items, bins)
            room = capacity - new.fill
            by_room.setdefault(room, []).append(new)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r, c in by_room.items() if c and r >= size), default=None)
            if room is None:
                host = BinClass((), -(-left // (capacity // size)))
                room = capacity
            else:
                host = by_room[room].pop()
            each = room // size
            full = min(host.bins, left // each)
            put((*host.items, *[size] * each), full)
            left -= full * each
            rest = host.bins - full
            if rest and left and left < each:
                put((*host.items, *[size] * left), 1)
                left, rest = 0, rest - 1
            if rest and host.items:
                put(host.items, rest)
    return [c for classes in by_room.values() for c in classes]


class _Sums:
    """The sums of one piece and of two pieces of a class, ascending, each with its pieces."""

    def __init__(self, items: tuple[int, ...]) -> None:
        ones = sorted({(x,) for x in items})
        twos = sorted(set(combinations(sorted(items), 2)), key=sum)
        self.one, self.two = ([sum(p) for p in ones], ones), ([sum(p) for p in twos], twos)


_NOTHING = ([0], [()])


def _best_exchange(giver: _Sums, taker: _Sums, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that fills a taker with ``room`` most: (gain, given, returned).

    Given and returned are one-for-none, one-for-one, two-for-one or one-for-two
    pieces; the gain is positive and within the taker's room.
    """
    best = None
    for (sums, given), (back, returned) in ((giver.one, _NOTHING), (giver.one, taker.one), (giver.two, taker.one), (giver.one, taker.two)):
        for t, pieces in zip(back, returned):
            at = bisect_right(sums, room + t) - 1
            if at >= 0 and sums[at] - t > (best[0] if best else 0):
                best = (sums[at] - t, given[at], pieces)
                if best[0] == room:
                    return best
    return best


def _replaced(items: tuple[int, ...], out: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(items)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *new], reverse=True))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound on the bins of any packing: pieces above half the capacity never share a bin.

    For each k, pieces above capacity - k fill a bin alone (none below k fits
    beside them), those above half have a bin each, and what of the pieces from k
    to half does not fit beside the latter needs more.
    """
    n, total = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for size, m in counts.items():
        n[size], total[size] = m, size * m
    n, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])  # of sizes below the index
    half, best = capacity // 2, 0
    for k in range(half + 1):
        alone, large = n[capacity + 1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
        spare = large * capacity - (total[capacity - k + 1] - total[half + 1])
        small = total[half + 1] - total[k]
        best = max(best, int(alone + large + max(0, -(-(small - spare) // capacity))))
    return best


def local_search(classes: list[BinClass], capacity: int) -> tuple[list[BinClass], int]:
    """(classes, exchanges): pieces shift from emptier underfull classes to fuller ones until bins empty.

    Every exchange makes the fuller bin fuller and the emptier one emptier, so
    the sum of squared fills grows and the search ends: at ``least_bins``, which
    no packing beats, or where no pair of underfull classes has an exchange left.
    A class that has found no taker is tried again only with classes that are
    newer than that. The work depends on the number of classes, not on the number
    of documents.
    """
    bins: dict[tuple[int, ...], int] = {}
    counts: dict[int, int] = {}
    for c in classes:
        key = tuple(sorted(c.items, reverse=True))
        bins[key] = bins.get(key, 0) + c.bins
        for x in key:
            counts[x] = counts.get(x, 0) + c.bins
    left = sum(bins.values()) - least_bins(counts, capacity)
    under = sorted((sum(k), k) for k in bins if sum(k) < capacity)  # by fill
    births: list[tuple[int, ...]] = []  # classes in the order they came up
    tried: dict[tuple[int, ...], int] = {}  # how many births there were when a class found no taker
    sums = functools.lru_cache(maxsize=4096)(_Sums)
    moves, at, moved = 0, 0, False
    while left > 0 and (at < len(under) or moved):
        if at == len(under):
            at, moved = 0, False
            continue
        fill, giver = under[at]
        if giver in tried:
            takers = sorted({(sum(k), k) for k in births[tried[giver] :] if k in bins and fill <= sum(k) < capacity}, reverse=True)
        else:
            takers = under[at:][::-1]
        found = None
        for other, taker in takers:  # the fullest first
            if taker == giver and bins[giver] < 2:
                continue
            move = _best_exchange(sums(giver), sums(taker), capacity - other)
            if move and (found is None or move[0] > found[0][0]):
                found = move, taker
                if move[0] == capacity - other:
                    break
        if found is None:
            tried[giver] = len(births)
            at += 1
            continue
        (_, given, returned), taker = found
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        moves, moved = moves + n, True
        for old in (giver, taker):
            bins[old] -= n
            if not bins[old]:
                del bins[old]
                tried.pop(old, None)
                under.pop(bisect_left(under, (sum(old), old)))
        for new in (_replaced(taker, returned, given), _replaced(giver, given, returned)):
            if not new:
                left -= n
            elif new in bins:
                bins[new] += n
                births.append(new)  # with more than one bin it can also give to itself
            else:
                bins[new] = n
                births.append(new)
                if sum(new) < capacity:
                    insort(under, (sum(new), new))
        at = bisect_left(under, (fill - sum(given) + sum(returned),))  # the giver, emptier, goes on giving
    return [BinClass(k, n) for k, n in sorted(bins.items(), reverse=True)], moves


def slot_table(classes: list[BinClass]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: arrays size, first (rank), sequence, offset, sorted."""
    done: dict[int, int] = {}
    rows, sequence = [], 0
    for c in classes:
        offset = 0
        for size in c.items:
            rows.append((size, done.get(size, 0), sequence, offset))
            done[size] = done.get(size, 0) + c.bins
            offset += size
        sequence += c.bins
    rows.sort()
    a = np.array(rows, dtype="int64").reshape(-1, 4)
    return {"size": a[:, 0], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def cut_pieces(vocabulary: str, capacity: int, end_id: int = 0):
    """mapInArrow function: (doc_id, text) to one row per piece of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                data, n = np.array(ids, dtype="<u4").tobytes(), len(ids)
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    rows.append((id_, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                    start, length = start + length, capacity
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _seat(shared):
    """mapInArrow function: adds sequence_id and offset by (length, _rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        span = int(slots["first"].max(initial=0)) + 1
        key = slots["size"] * span + slots["first"]  # sizes are at most the capacity, so this stays far below 2^63
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length * span + np.minimum(rank, span - 1), side="right") - 1
            sequence, offset = slots["sequence"][at] + rank - slots["first"][at], slots["offset"][at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(5)], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = tokens.VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's and a final 0 (a null or empty text: just
    the 0, one piece of length 1). Documents longer than ``capacity`` are cut;
    the first piece takes the odd rest. A repeated row is packed again, as a
    document of its own; an empty table gives an empty result; other columns are
    not read. Sequences hold at most ``capacity`` ids without gaps.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch(read.mapInArrow(cut_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    classes, _ = local_search(best_fit_classes(counts, capacity), capacity)
    slots = docs.sparkSession.sparkContext.broadcast(slot_table(classes))  # a row per piece of a class: what lengths there are bounds it
    ranked = gapless(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInArrow(_seat(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
