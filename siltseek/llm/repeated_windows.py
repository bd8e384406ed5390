"""Suffix-array dedup: repeated byte windows by a depth-limited radix sort.

A byte goes if a window of ``width`` bytes over it also starts earlier. Sorting
every suffix of the corpus would move each byte a hundred times, so windows are
first dealt by their leading digit, chosen by content: of the ``GRAM``-byte
grams in a window the one with the least hash (the leftmost of equals). Equal
windows choose the same gram at the same place, so they meet under its hash, and
one gram stands for a run of neighbouring windows (a *span*).

1. Each task cuts its texts into spans. Spans that are equal byte for byte keep
   their first occurrence; the windows of the others are repeated. One entry per
   (task block, span) travels on, so a passage in every document is one entry a
   block, not one a document.
2. Grams with very many entries (by a count of a fixed share of all entries, which
   decides nothing but the way they take) are dealt by window instead of by gram:
   each block keeps the first of its equal windows, then each of some cells does,
   then all cells' firsts meet. No gram's entries meet in one task.
3. The other entries meet by gram. A gram seen once is done: its windows occur
   once. Equal spans keep the first again. Only grams with several *different*
   spans are left.
4. The bytes of those spans are fetched, and their windows sorted by most
   significant digit, 8 bytes a pass, to depth ``width`` and no further; windows
   that are alone in their group leave after each pass. What is left in one
   group is one window's text, compared byte for byte, not by hash.

Spans and windows that are dealt by themselves are compared by two 64-bit hashes
of different substrings (128 bits) and their gram's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan
from siltseek.llm.scratch import scratch

WIDTH, GRAM = 100, 24
#: A gram with more entries than this, and than one in ``HOT`` of all, has its windows dealt one by one.
SPREAD = 16_384
#: So many grams may be dealt by window, about; their hashes are broadcast (8 bytes each).
HOT = 1 << 20
#: Cells in which equal windows meet before they all do.
CELLS = 64
_LAST = (1 << 63) - 1
_ENTRY = ["h", "g", "doc", "at", "before", "more"]
_KINDS = ["<u8", "<u8", "<u4", "<i8", "u1", "u1"]
_INTERVALS = "doc_id long, key long, starts array<long>, ends array<long>"
_ENTRIES = "bucket int, doc_ids binary, keys binary, " + ", ".join(f"{c} binary" for c in _ENTRY) + f", {_INTERVALS}"
_LIST = pa.list_(pa.int64())
_SCHEMA = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("doc_ids", "keys", *_ENTRY)], ("doc_id", pa.int64()), ("key", pa.int64()), ("starts", _LIST), ("ends", _LIST)])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def spans(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> dict[str, np.ndarray]:
    """The spans of a block: h, g (hashes), doc, at (first window), before, more.

    A span's windows start at at, at + 1, ..., at + more; its gram starts
    ``before`` bytes after ``at``. Positions count from the block's start.
    """
    lengths = np.diff(offsets)
    none = {c: np.zeros(0, k) for c, k in zip(_ENTRY, _KINDS)}
    if not (lengths >= width).any():
        return none
    sums = bytescan.Sums(data)
    rolled = sums.rolling(GRAM)
    place = np.arange(len(rolled), dtype=np.uint64)
    least = _sliding_least((rolled & np.uint64(0xFFFFFFFF00000000)) | place, width - GRAM + 1)
    gram = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long_enough = np.flatnonzero(lengths >= width)
    first, last = offsets[long_enough], offsets[long_enough + 1] - width  # windows of each document
    change = np.ones(len(gram), bool)
    change[1:] = gram[1:] != gram[:-1]
    change[first] = True
    at = np.flatnonzero(change)
    doc = np.searchsorted(first, at, side="right") - 1
    inside = (doc >= 0) & (at <= last[np.maximum(doc, 0)])
    at, doc = at[inside], doc[inside]
    after = np.append(at[1:], len(gram)) - 1
    more = np.minimum(after, last[doc]) - at
    p = gram[at]
    return {"h": rolled[p], "g": sums.hashes(at, at + more + width), "doc": long_enough[doc].astype("<u4"), "at": at, "before": (p - at).astype("u1"), "more": more.astype("u1")}


def sliced_spans(data: np.ndarray, offsets: np.ndarray, width: int, limit: int = bytescan.BLOCK) -> dict[str, np.ndarray]:
    """``spans``, with a document far above ``limit`` scanned in overlapping slices."""
    if len(offsets) != 2 or len(data) <= 2 * limit:
        return spans(data, offsets, width)
    found = []
    for first in range(0, len(data) - width + 1, limit):
        part = data[first : first + limit + width - 1]
        s = spans(part, np.array([0, len(part)]), width)
        found.append(s | {"at": s["at"] + first})
    return {c: np.concatenate([s[c] for s in found]) for c in _ENTRY}


def _first_of_equals(columns: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows sorted by columns then order, which are the first of their equals, which come later).

    A row at the very place of the first (a document listed twice) is neither.
    """
    by = np.lexsort([*order[::-1], *columns[::-1]])
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    again = np.any([c[by] != c[by][head] for c in order], axis=0) if len(by) else new
    return by, new, again


def _interval_rows(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
    """One row per document (id and key) with its intervals, touching ones merged."""
    by = np.lexsort((starts, docs, keys))
    docs, keys, starts, ends = docs[by], keys[by], starts[by].astype(np.int64), ends[by].astype(np.int64)
    own = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
    which = np.cumsum(own) - 1
    docs, keys = docs[own], keys[own]
    if len(which):
        shift = which * (int(ends.max()) + 1)  # keeps the running maximum within a document
        reach = np.maximum.accumulate(ends + shift)
        new = np.ones(len(which), bool)
        new[1:] = own[1:] | (starts[1:] + shift[1:] > reach[:-1])
        at = np.flatnonzero(new)
        ends, starts, which = np.maximum.reduceat(ends, at), starts[at], which[at]
    counts = np.bincount(which, minlength=len(keys))
    return {"doc_id": pa.array(docs, pa.int64()), "key": pa.array(keys, pa.int64()), "starts": bytescan.list_column(starts, counts, pa.int64()), "ends": bytescan.list_column(ends, counts, pa.int64())}


def _batch(schema: pa.Schema, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns, and nulls for the rest of the schema."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def windows_of(s: dict[str, np.ndarray], data: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Each window of the spans as a span of its own, under a hash of itself instead of its gram's."""
    n = s["more"].astype(np.int64) + 1
    span = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    at = s["at"][span] + step
    before = s["before"][span] - step  # each window of a span holds the span's gram
    g = bytescan.Sums(data).hashes(at, at + width)
    h = bytescan.mixed(s["h"][span] ^ bytescan.mixed(g + before.astype(np.uint64)))
    return {"h": h, "g": g, "doc": s["doc"][span], "at": at, "before": before.astype("u1"), "more": np.zeros(len(at), "u1")}


def _packed(s: dict[str, np.ndarray], doc_ids: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries as one row a bucket; ``doc`` of an entry is a row of ``doc_ids`` and ``keys``."""
    bucket = (s["h"] % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    out: list[list] = [[] for _ in range(9)]
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        docs, ref = np.unique(s["doc"][part], return_inverse=True)
        values = [bucket[part[0]], doc_ids[docs].astype("<i8").tobytes(), keys[docs].astype("<i8").tobytes()]
        values += [(ref if c == "doc" else s[c][part]).astype(k).tobytes() for c, k in zip(_ENTRY, _KINDS)]
        for column, value in zip(out, values):
            column.append(value)
    return _batch(_SCHEMA, {f.name: pa.array(c, f.type) for f, c in zip(_SCHEMA, out)})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """All entries of packed rows, each with its document's id and key."""
    parts: dict[str, list[np.ndarray]] = {"doc_id": [np.zeros(0, "<i8")], "key": [np.zeros(0, "<i8")]} | {c: [np.zeros(0, k)] for c, k in zip(_ENTRY, _KINDS) if c != "doc"}
    for batch in batches:
        for row in batch.to_pylist():
            ref = np.frombuffer(row["doc"], "<u4")
            parts["doc_id"].append(np.frombuffer(row["doc_ids"], "<i8")[ref])
            parts["key"].append(np.frombuffer(row["keys"], "<i8")[ref])
            for c, k in zip(_ENTRY, _KINDS):
                if c != "doc":
                    parts[c].append(np.frombuffer(row[c], k))
    return {c: np.concatenate(parts.pop(c)) for c in list(parts)}


def _later(s: dict[str, np.ndarray], width: int) -> tuple[dict[str, np.ndarray], dict[str, pa.Array]]:
    """(the first of equal spans, the intervals of the others)."""
    by, first, again = _first_of_equals([s["h"], s["g"], s["before"], s["more"]], [s["doc_id"], s["key"], s["at"]])
    s = {c: v[by] for c, v in s.items()}
    gone = _interval_rows(s["doc_id"][again], s["key"][again], s["at"][again], s["at"][again] + s["more"][again] + width)
    return {c: v[first] for c, v in s.items()}, gone


def _deal_spans(buckets: int, width: int, hot=None):
    """mapInArrow: (doc_id, key, text) to entries by bucket, and intervals repeated within a block.

    With ``hot`` grams, only their windows are dealt, one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a window is some 100 bytes of work, so blocks of windows are smaller
        for rows, data, offsets in bytescan.blocks(batches, limit=bytescan.BLOCK if hot is None else bytescan.BLOCK // 4):
            s = sliced_spans(data, offsets, width)
            if hot is not None:
                s = {c: v[np.isin(s["h"], hot.value)] for c, v in s.items()}
                s = windows_of(s, data, width)
            if not len(s["h"]):
                continue
            doc_ids, keys = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            s["at"] = s["at"] - offsets[s["doc"]]
            s, gone = _later(s | {"doc_id": doc_ids[s["doc"]], "key": keys[s["doc"]]}, width)
            yield _batch(_SCHEMA, gone)
            yield _packed(s, doc_ids, keys, buckets)

    return run


def _collapse(buckets: int, width: int):
    """mapInArrow over a cell's entries: the first of equal ones as entries again, the others' intervals.

    Rows that are intervals already pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = pc.is_valid(batch.column(batch.schema.get_field_index("key")))
            yield batch.filter(done).cast(_SCHEMA)
            held.append(batch.filter(pc.invert(done)))
        s = _unpacked(iter(held))
        if len(s["h"]):
            s, gone = _later(s, width)
            yield _batch(_SCHEMA, gone)
            yield _packed(s | {"doc": np.arange(len(s["h"]))}, s["doc_id"], s["key"], buckets)

    return run


#: One in so many entries is counted to find the grams with very many.
_COUNTED = 16


def _counted(share: int):
    """mapInArrow: (doc_ids, doc, h, g, at) of entries to (h, n) of one in ``share`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, g, at = np.frombuffer(row["h"], "<u8"), np.frombuffer(row["g"], "<u8"), np.frombuffer(row["at"], "<i8")
                doc = np.frombuffer(row["doc_ids"], "<u8")[np.frombuffer(row["doc"], "<u4")]
                drawn = bytescan.mixed(bytescan.mixed(g ^ doc) + at.view(np.uint64)) % np.uint64(share) == 0
                one, n = np.unique(h[drawn], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def hot_grams(entries: DataFrame, spread: int, most: int = HOT) -> np.ndarray:
    """The grams with more than about ``spread`` entries and one in ``most`` of all; at most ``most``, about."""
    total = entries.agg(F.coalesce(F.sum(F.octet_length("more")), F.lit(0))).first()[0]  # a byte each
    least = max(spread, total // most)
    share = _COUNTED if least >= 64 * _COUNTED else 1
    drawn = entries.select("doc_ids", "doc", "h", "g", "at").mapInArrow(_counted(share), "h long, n long")
    found = drawn.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * share > least).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _without(hot):
    """mapInArrow: packed entries less those of hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                keep = ~np.isin(np.frombuffer(row["h"], "<u8"), hot.value)
                if not keep.all():
                    for c, k in zip(_ENTRY, _KINDS):
                        row[c] = np.frombuffer(row[c], k)[keep].tobytes()
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


_MET = f"{_INTERVALS}, gram array<long>, before array<short>"
_MET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", _LIST), ("ends", _LIST), ("gram", _LIST), ("before", pa.list_(pa.int16()))])


def _meet_by_gram(width: int):
    """mapInArrow over a partition of entries: repeated intervals, and wanted spans.

    Intervals to remove have a null ``gram``; rows with one ask for the bytes of
    spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _unpacked(batches)
        if not len(s["h"]):
            return
        by = np.argsort(s["h"])
        h = s["h"][by]
        twin = np.zeros(len(h), bool)
        twin[1:] = h[1:] == h[:-1]
        twin[:-1] |= twin[1:]
        s, gone = _later({c: v[by[twin]] for c, v in s.items()}, width)
        yield _batch(_MET_SCHEMA, gone)
        _, which, counts = np.unique(s["h"], return_inverse=True, return_counts=True)
        s = {c: v[counts[which] > 1] for c, v in s.items()}
        by = np.lexsort((s["at"], s["doc_id"], s["key"]))
        s = {c: v[by] for c, v in s.items()}
        own = np.flatnonzero(np.append(True, (s["key"][1:] != s["key"][:-1]) | (s["doc_id"][1:] != s["doc_id"][:-1]))[: len(by)])
        counts = np.diff(np.append(own, len(by)))
        lists = {"starts": (s["at"], pa.int64()), "ends": (s["at"] + s["more"] + width, pa.int64()), "gram": (s["h"].view(np.int64), pa.int64()), "before": (s["before"], pa.int16())}
        yield _batch(_MET_SCHEMA, {"doc_id": pa.array(s["doc_id"][own]), "key": pa.array(s["key"][own])} | {c: bytescan.list_column(v, counts, k) for c, (v, k) in lists.items()})

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, key, text, starts, ends, gram, before) to span bytes by route."""
    for batch in batches:
        for rows, data, offsets in bytescan.blocks(iter([batch])):
            get = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: E731, B023
            counts = get("starts").value_lengths().to_numpy()
            row = np.repeat(np.arange(rows.num_rows), counts)
            starts, ends, gram, before = (get(c).flatten().to_numpy() for c in ("starts", "ends", "gram", "before"))
            text = data.tobytes()
            spans_ = [text[a:e] for a, e in zip((starts + offsets[row]).tolist(), (ends + offsets[row]).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(gram), get("doc_id").take(pa.array(row)), get("key").take(pa.array(row)), pa.array(starts), pa.array(256 - before, pa.int16()), pa.array(spans_, pa.binary())], ["route", "doc_id", "key", "at", "phase", "span"])


def radix_groups(buffer: np.ndarray, window: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur again, and their groups, by most significant digits.

    ``window`` holds positions in ``buffer``; only windows with equal ``group``
    are compared. The digits are 8 bytes; the last one may overlap its
    neighbour. The outer digits go first, as texts part at a span's ends. Returns
    (indices into ``window``, group numbers); lone windows are not returned.
    """
    digits = sorted({*range(0, width - 7, 8), width - 8}, key=lambda d: -abs(2 * d + 8 - width))
    words = np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer, strides=(1,))
    live = np.arange(len(window))
    for d in [None, *digits]:
        if d is None:
            by = np.argsort(group, kind="stable")
            g = group[by]
            new = np.ones(len(by), bool)
            new[1:] = g[1:] != g[:-1]
        else:
            digit = words[window[live] + d]
            by = np.lexsort((digit, group))
            g, x = group[by], digit[by]
            new = np.ones(len(by), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        keep = ~alone
        group = np.cumsum(new)[keep]
        live = live[by[keep]]
    return live, group


def _sort_windows(width: int):
    """mapInArrow over a partition of spans: repeated intervals by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        route, doc_id, key, at, phase = (table.column(c).to_numpy() for c in ("route", "doc_id", "key", "at", "phase"))
        lengths = np.array([len(x) for x in table.column("span").to_pylist()], np.int64)
        buffer = np.frombuffer(b"".join(table.column("span").to_pylist()), np.uint8).copy()
        base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        n = lengths - width + 1
        span = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        # windows of one gram are equal only if the gram stands at the same place in both
        same = bytescan.mixed(route.view(np.uint64)[span] ^ bytescan.mixed((phase[span] + step).astype(np.uint64)))
        live, group = radix_groups(buffer, base[span] + step, same, width)
        span, start = span[live], (at[span] + step)[live]
        by, _, later = _first_of_equals([group], [doc_id[span], key[span], start])
        again = by[later]
        found = _interval_rows(doc_id[span[again]], key[span[again]], start[again], start[again] + width)
        yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    return run


def _apply():
    """mapInArrow: (doc_id, key, text, starts, ends) to counts, spans and kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in bytescan.blocks(iter([batch])):
                starts, ends = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("starts", "ends"))
                out: list[list] = [[] for _ in range(4)]
                for i in range(rows.num_rows):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    runs: list[list[int]] = []
                    for a, e in sorted(zip(starts[i] or (), ends[i] or ())):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(e, runs[-1][1])
                        else:
                            runs.append([a, e])
                    at, kept = 0, []
                    for a, e in runs:
                        kept.append(text[at:a])
                        at = e
                    kept.append(text[at:])
                    for column, value in zip(out, (len(text), sum(e - a for a, e in runs), runs, b"".join(kept))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int64()))), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, removed, kept.

    ``removed`` lists the [start, end) byte runs taken out, ``kept`` is what is
    left, as bytes (a cut may fall within a character). A window is repeated if
    an equal one starts earlier: in a document with a smaller id, or in the same
    one at a smaller offset. ``width`` is 32 to 128 bytes. A null or empty text
    has no bytes; a null id comes after all ids; of different texts with one id
    the order is fixed by their hash; rows that repeat (id, text) are one
    document listed twice and get the same answer. An empty table gives an empty
    result; other columns are not read.
    """
    if not 32 <= width <= 128:
        raise ValueError("width must be 32 to 128 bytes")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc_id"), F.xxhash64(id_, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    entries = scratch(rows.mapInArrow(_deal_spans(4 * n, width), _ENTRIES), "entries")
    intervals, packed = ["doc_id", "key", "starts", "ends"], ["bucket", "doc_ids", "keys", *_ENTRY]
    every = [entries.where("key IS NOT NULL").select(*intervals)]
    entries = entries.where("key IS NULL").select(*packed)
    hot = hot_grams(entries, spread)
    if len(hot):
        shared = spark.sparkContext.broadcast(hot)
        windows = rows.mapInArrow(_deal_spans(4 * n, width, shared), _ENTRIES)
        cell = F.pmod(F.xxhash64("doc_ids", "at", "key"), F.lit(CELLS))
        firsts = scratch(windows.repartition(n, "bucket", cell).mapInArrow(_collapse(4 * n, width), _ENTRIES), "cells")
        every.append(firsts.where("key IS NOT NULL").select(*intervals))
        schema = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in packed)
        entries = entries.mapInArrow(_without(shared), schema).unionByName(firsts.where("key IS NULL").select(*packed))
    met = scratch(entries.repartition(n, "bucket").mapInArrow(_meet_by_gram(width), _MET), "met")
    wanted = met.where("gram IS NOT NULL").groupBy("doc_id", "key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "gram", "before")])
    fetched = rows.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "starts", "ends", "gram", "before")
    fetched = fetched.mapInArrow(_fetch, "route long, doc_id long, key long, at long, phase short, span binary").repartition(n, "route")
    every += [met.where("gram IS NULL").select(*intervals), fetched.mapInArrow(_sort_windows(width), _INTERVALS)]
    removed = reduce(DataFrame.unionByName, every).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    done = rows.join(removed, ["doc_id", "key"], "left").select("doc_id", "text", "starts", "ends")
    done = done.mapInArrow(_apply(), "doc_id long, n_bytes long, n_removed long, removed array<array<long>>, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


def op7_repeated_windows(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.lower(F.sha2("kept", 256)).alias("kept_sha256"))


# Texts are hex strings, cut into overlapping parts of 1,000 windows, as a long text's characters are counted from its start.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2 * 1099) AS h FROM d, unnest(range(0, length(h) // 2 - 99, 1000)) AS t(p)
), win AS (
  SELECT doc_id, p + i AS pos, md5(substr(h, 2 * i + 1, 200)) AS w FROM part, unnest(range(0, least(1000, length(h) // 2 - 99))) AS t(i)
), firsts AS (
  SELECT w, min(row(doc_id, pos)) AS head FROM win GROUP BY 1 HAVING count(*) > 1
), again AS (
  SELECT doc_id, pos FROM win JOIN firsts USING (w) WHERE row(doc_id, pos) <> head
), edges AS (
  SELECT *, pos > coalesce(max(pos + 100) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM again
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 100 AS e FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM edges) GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM runs GROUP BY 1
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(starts) + 1),
    lambda j: substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * ends[j] + 1 END, CASE WHEN j = len(starts) THEN length(h) ELSE 2 * starts[j + 1] - CASE WHEN j = 0 THEN 0 ELSE 2 * ends[j] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
