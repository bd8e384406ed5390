"""Benchmark decontamination: BM25 with block-max WAND, then verified overlap.

The test items are indexed: term -> (item, impact) postings, items in blocks
with each term's largest impact in the block. Every passage of every training
text is a query. A passage whose terms' largest impacts cannot reach any item's
threshold is done; of the others only the item blocks whose block maxima reach
the block's least threshold are scored, and postings of all other blocks are
skipped unread (block-max WAND with a block of items as the pivot). Items at or above their threshold are
verified: ``SHARE`` of the item's word shingles must occur in the passage, and
half of those of its question and of its answer.

An item's threshold is the least BM25 score a passage that passes verification
can have (each missing shingle accounts for one missing word at most, so it is
the item's own score without its highest impacts), so nothing is lost to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltseek.llm import bytescan

WORDS, SHARE = 5, 0.8
K1, B = 1.2, 0.75
#: Items in a block at least, and blocks at most.
ITEM_BLOCK, BLOCKS = 4, 64
#: Items are indexed and broadcast in groups of at most so much text.
GROUP_BYTES = 2 << 20
_LAST = (1 << 63) - 1
#: Everything but ASCII letters and digits and the bytes of other characters parts words.
_BLANK = np.ones(256, bool)
_BLANK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ODD = np.random.default_rng(9).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word, lower-cased A-Z."""
    data = bytescan.LOWER[data]
    start, end, doc = bytescan.words(data, offsets, _BLANK)
    return bytescan.Sums(data).hashes(start, end), doc


def shingled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` words in a row."""
    n = max(0, len(words) - size + 1)
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x += words[j : j + n] * _ODD[j]
    return bytescan.mixed(x)


@dataclass
class Index:
    ids: np.ndarray
    shingles: list[np.ndarray]
    sizes: np.ndarray  # words in a shingle
    question: np.ndarray  # how many of the shingles are the question's
    vocabulary: np.ndarray
    first: np.ndarray  # postings of term t in item block b: first[t, b] to first[t, b + 1]
    item: np.ndarray
    impact: np.ndarray
    least: np.ndarray  # threshold by item
    most: np.ndarray  # largest impact by term
    block_most: np.ndarray  # by term and item block
    block_least: np.ndarray
    block: int  # items in a block
    reach: int  # words of the longest item of all groups


def build_index(ids: list[int], questions: list[str | None], answers: list[str | None], words: int = WORDS, share: float = SHARE, reach: int = 0) -> Index | None:
    """The index of test items; an item without words can't be found and is left out.

    Without an answer text, the second half of the item's shingles is the answer.
    ``reach`` is the number of words of the longest item, if that is in another group.
    """
    kept: list[tuple[int, np.ndarray, int]] = []
    for id_, q, a in zip(ids, questions, answers):
        q, a = (np.frombuffer((x or "").encode(), np.uint8) for x in (q, a))
        both = np.concatenate([q, np.array([0x20], np.uint8), a])
        hashes, _ = word_hashes(both, np.array([0, len(both)]))
        n_q = len(word_hashes(q, np.array([0, len(q)]))[0])
        if len(hashes):
            kept.append((id_, hashes, n_q if len(hashes) > n_q else -1))
    if not kept:
        return None
    kept.sort(key=lambda k: (len(k[1]), k[0]))  # a block's items have thresholds alike
    n = len(kept)
    sizes = np.array([min(words, len(h)) for _, h, _ in kept])
    shingles = [shingled(h, s) for (_, h, _), s in zip(kept, sizes)]
    counts = np.array([len(s) for s in shingles])
    question = np.array([-(-c // 2) if q < 0 else min(max(q - s + 1, 0), c) for (_, _, q), c, s in zip(kept, counts, sizes)])
    lengths = np.array([len(h) for _, h, _ in kept])
    token, owner = np.concatenate([h for _, h, _ in kept]), np.repeat(np.arange(n), lengths)
    vocabulary, term = np.unique(token, return_inverse=True)
    pair, tf = np.unique(term * n + owner, return_counts=True)
    term, item = pair // n, pair % n
    df = np.bincount(term, minlength=len(vocabulary))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / lengths.mean()))
    least = np.zeros(n)
    by = np.lexsort((impact, item))
    at = np.searchsorted(item[by], np.arange(n + 1))
    for i in range(n):
        own = impact[by[at[i] : at[i + 1]]]
        least[i] = own[: max(0, len(own) - int((1 - share) * counts[i] + 1e-9))].sum()
    block = max(ITEM_BLOCK, -(-n // BLOCKS))
    blocks = -(-n // block)
    runs = np.concatenate([[0], np.cumsum(np.bincount(term * blocks + item // block, minlength=len(vocabulary) * blocks))])  # postings lie by term, then item
    first = np.concatenate([runs[:-1].reshape(-1, blocks), runs[blocks::blocks, None]], axis=1).astype(np.int32)
    block_most = np.zeros((len(vocabulary), blocks), np.float32)
    np.maximum.at(block_most, (term, item // block), impact.astype(np.float32) * np.float32(1 + 1e-6))
    block_least = np.minimum.reduceat(least, np.arange(0, n, block))
    return Index(np.array([k[0] for k in kept]), shingles, sizes, question, vocabulary, first, item, impact, least, block_most.max(1).astype(float), block_most, block_least, block, max(reach, int(lengths.max())))


def find(index: Index, data: np.ndarray, offsets: np.ndarray, share: float = SHARE) -> list[tuple[int, int, int]]:
    """(document, item, shared shingles) of each verified match in a block of texts."""
    hashes, doc = word_hashes(data, offsets)
    if not len(hashes):
        return []
    n_docs, stride = len(offsets) - 1, index.reach
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    # passages of 2 x stride words start at every stride-th word; a word is in two of them
    number = (np.arange(len(doc)) - first[doc]) // stride
    passages = np.where(n > 0, (n - 1) // stride + 1, 0)
    base = np.cumsum(passages) - passages
    term = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
    known = index.vocabulary[term] == hashes
    passage, term, again = (base[doc] + number)[known], term[known], number[known] > 0
    size = len(index.vocabulary)
    pair = np.concatenate([passage * size + term, (passage[again] - 1) * size + term[again]])
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    passage, term = pair // size, pair % size
    bound = np.bincount(passage, index.most[term], int(passages.sum()))
    live = bound >= index.least.min() * (1 - 1e-9)
    hopeful = live[passage]
    passage, term = passage[hopeful], term[hopeful]
    at = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else passage
    ends = np.append(at[1:], len(passage))
    best: dict[tuple[int, int], int] = {}
    for lo in range(0, len(at), 4096):  # the block maxima of some thousand passages at a time
        part = slice(lo, min(lo + 4096, len(at)))
        rows = index.block_most[term[at[part][0] : ends[part][-1]]]
        reach = np.add.reduceat(rows, at[part] - at[part][0], axis=0) >= index.block_least * (1 - 1e-5)
        for i in np.flatnonzero(reach.any(1)):
            _verify(index, passage[at[lo + i]], term[at[lo + i] : ends[lo + i]], reach[i], hashes, first, n, base, passages, share, best)
    return [(d, i, m) for (d, i), m in best.items()]


def postings(index: Index, terms: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Places of the terms' postings in the item blocks that are left; those of other blocks are skipped."""
    start, end = (index.first[terms][:, blocks + i].ravel().astype(np.int64) for i in (0, 1))
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _verify(index: Index, p: int, terms: np.ndarray, blocks: np.ndarray, hashes: np.ndarray, first: np.ndarray, n: np.ndarray, base: np.ndarray, passages: np.ndarray, share: float, best: dict[tuple[int, int], int]) -> None:
    """Scores a passage against the items of ``blocks`` and verifies those at their threshold."""
    stride = index.reach
    read = postings(index, terms, np.flatnonzero(blocks))
    score = np.bincount(index.item[read], index.impact[read], len(index.ids))
    found = np.flatnonzero((score > 0) & (score >= index.least * (1 - 1e-9)))
    if not len(found):
        return
    d = int(np.searchsorted(base + passages, p, side="right"))
    start = first[d] + (p - base[d]) * stride
    words = hashes[start : min(start + 2 * stride, first[d] + n[d])]
    for i in found:
        there = np.sort(shingled(words, int(index.sizes[i])))
        if not len(there):
            continue
        own = index.shingles[i]
        hit = there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own
        q = int(index.question[i])
        if hit.sum() >= share * len(own) - 1e-9 and 2 * hit[:q].sum() >= q and 2 * hit[q:].sum() >= len(own) - q:
            best[d, i] = max(best.get((d, i), 0), int(hit.sum()))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows, data, offsets in bytescan.blocks(batches):
            found = find(index, data, offsets)
            ids = rows.column(0).to_numpy()
            columns = ([int(ids[d]) for d, _, _ in found], [int(index.ids[i]) for _, i, _ in found], [m for _, _, m in found], [len(index.shingles[i]) for _, i, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "total"])

    return run


def _most_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (text) to the largest number of words of a text, by block."""
    for _, data, offsets in bytescan.blocks(batches):
        _, doc = word_hashes(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([int(np.bincount(doc, minlength=1).max())])], ["n"])


def _indices(items: DataFrame, question_col: str, answer_col: str | None) -> Iterator[Index]:
    """Indices of the test items, in groups of bounded size; all search passages of the same length."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(question_col).cast("string").alias("q"), answer.alias("a")).where("item_id IS NOT NULL").distinct()
    size = tests.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "q", "a"))), F.lit(0))).first()[0]
    groups = 1 + size // GROUP_BYTES
    reach = 0
    if groups > 1:
        both = tests.select(F.concat_ws(" ", "q", "a").alias("text"))
        reach = both.mapInArrow(_most_words, "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    for g in range(groups):
        part = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id", "q").toArrow()
        index = build_index(*(part.column(c).to_pylist() for c in ("item_id", "q", "a")), reach=reach)
        if index is not None:
            yield index


def _without(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col)), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            keep = np.ones(batch.num_rows, bool)
            for rows, data, offsets in bytescan.blocks(iter([named])):
                keep[rows.column(1).to_numpy()[[d for d, _, _ in find(shared.value, data, offsets)]]] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The documents in which no test item is found, with all their columns.

    Null and empty texts hold no item and stay, null and empty items are in none;
    rows that repeat an id and text all stay or all go; ids are not read; an empty
    table on either side drops nothing.
    """
    for index in _indices(items, question_col, answer_col):
        docs = docs.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(index), text_col), docs.schema)
    return docs


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", question_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """One row per (document, test item) found in it: doc_id, item_id, shared, total.

    ``shared`` of the item's ``total`` shingles (five words; fewer for shorter
    items) occur in one passage of the document, ``SHARE`` of them at least.
    Null and empty texts and items have no words and are never found; a null
    document id stays null, a null item id is left out; rows that repeat an id
    and text give one row; an empty table on either side gives an empty result;
    other columns are not read. Items are broadcast in groups of bounded size.
    """
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = None
    for index in _indices(items, question_col, answer_col):
        hits = rows.mapInArrow(_search(spark.sparkContext.broadcast(index)), "doc_id long, item_id long, shared long, total long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, shared long, total long")
    found = found.groupBy("doc_id", "item_id", "total").agg(F.max("shared").alias("shared"))
    return found.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "item_id", "shared", "total")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM benchmark
), stride AS (
  SELECT max(len(w)) AS s FROM iw
), ish AS (
  SELECT item_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g, len(w) - k + 1 AS total
  FROM (SELECT *, least(5, len(w)) AS k FROM iw WHERE len(w) > 0), unnest(range(0, len(w) - k + 1)) AS t(i)
), dsh AS (
  SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM dw, (SELECT DISTINCT k FROM ish), unnest(range(0, len(w) - k + 1)) AS t(i) WHERE len(w) >= k
), near AS (
  SELECT doc_id, k, i, g FROM dsh WHERE (k, g) IN (SELECT (k, g) FROM ish)
), passages AS (
  SELECT DISTINCT doc_id, p, k, g FROM near, stride, unnest([i // s, i // s - 1]) AS t(p)
  WHERE p >= 0 AND i >= p * s AND i + k <= (p + 2) * s
), hits AS (
  SELECT doc_id, item_id, p, total, count(*) AS shared, count(*) FILTER (WHERE i < (total + 1) // 2) AS q
  FROM passages JOIN ish USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, max(shared) AS shared, total FROM hits
WHERE 10 * shared >= 8 * total AND 2 * q >= (total + 1) // 2 AND 2 * (shared - q) >= total - (total + 1) // 2
GROUP BY doc_id, item_id, total
"""
