"""What one search needs of whole documents, in one pass over their texts and without a shuffle.

A row a document: its hashed vector as counts, how often each term asked for
occurs, its number of terms and its topics. Terms, hashing and topics are those
of ``functions`` and ``dense.HashingEmbedder``; here they are found by byte
tables over many texts at once, each different name being looked at once.
Patterns hold ASCII alone, so bytes of other characters only part names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltseek.functions import lexicon as L

#: Texts and bytes of texts (a longer text is alone), and numbers of all vectors, at a time; terms a worker remembers.
TEXTS, BYTES, NUMBERS, REMEMBERED = 1024, 4 << 20, 1 << 20, 1 << 17
#: Terms up to this length are appended to a hash by table.
_LONGEST = 64

_NOISE, _STOP = ({w.encode() for w in words} for words in (L.CODE_NOISE, L.STOPWORDS))
_CAMEL = re.compile(L.CAMEL_BOUNDARY.encode())
_BLOCK, _STRING = (re.compile(p.encode(), re.DOTALL) for p in (L.BLOCK_COMMENT, L.STRING_LITERAL))
_LINE = re.compile(L.LINE_COMMENT.encode(), re.MULTILINE)
_TOPICS = [code for _, code in L.TOPICS.values()]
#: Arrow counts on after a match as if a text began there, so a word cut by a match's end would begin anew: such texts are counted by ``re``.
_CUT = {"dp": r"lru_cache\w", "bits": r"&[\s\x0b]*\w\w"}
#: Characters that are equal to an ASCII letter when case is ignored.
_FOLDED = {0x17F: "s", 0x212A: "k", 0x130: "i", 0x131: "i"}


def _kinds(first: str) -> np.ndarray:
    """0 for bytes outside a name, 1 for those that begin one, 2 for digits."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"0123456789")] = 2
    kinds[[b for b in range(128) if re.match(first, chr(b))]] = 1
    return kinds


_IN_IDENTIFIER, _IN_WORD = _kinds("[A-Za-z_]"), _kinds("[A-Za-z]")


def _appended() -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC-32 becomes when n bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    rows = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(_LONGEST):
        rows.append(step[rows[-1] & 255] ^ (rows[-1] >> np.uint32(8)))
    return np.stack(rows)


_tables: list[np.ndarray] = []


def ascii_table(spark: SparkSession) -> np.ndarray:
    """[code point]: the ASCII character that the topics' patterns cannot tell from it, by the JVM's own classes."""
    if _tables:
        return _tables[0]
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    text = F.col("t")
    for pattern, new in ((r"(?U)[\w&&[^\x00-\x7F]]", "0"), (r"(?U)[\s&&[^\x00-\x7F]]", " "), (r"[^\x00-\x7F]", "\x01")):
        text = F.regexp_replace(text, pattern, new)
    known = spark.createDataFrame([("".join(map(chr, points)),)], "t string").select(text.alias("t")).collect()[0]["t"]
    table = np.arange(0x110000).astype(np.uint8)
    table[points] = np.frombuffer(known.encode(), np.uint8)
    for point, letter in _FOLDED.items():
        table[point] = ord(letter)
    _tables.append(table)
    return table


def topic_counts(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Matches of each topic's pattern in code, a row a text."""
    plain = [t if t.isascii() else table[np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)].tobytes() for t in texts]
    column, found = pa.array(plain, pa.large_binary()), np.zeros((len(texts), len(_TOPICS)))
    for i, (name, pattern) in enumerate(zip(L.TOPICS, _TOPICS)):
        found[:, i] = pc.count_substring_regex(column, pattern.replace(r"\s", r"[\s\x0b]"), ignore_case=True).to_numpy()
        if name in _CUT:
            exact = re.compile(pattern.encode(), re.IGNORECASE)
            for row in np.flatnonzero(pc.match_substring_regex(column, _CUT[name], ignore_case=True).to_numpy(zero_copy_only=False)):
                found[row, i] = sum(1 for _ in exact.finditer(plain[row]))
    return found


def _names(texts: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each name in order, the different names, place of each text's first name and the end)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    kind = kinds[data]
    edges = np.flatnonzero(np.diff(kind > 0, prepend=False, append=False))
    start, end = edges[::2].copy(), edges[1::2]
    late = np.flatnonzero(kind[start] == 2)
    if len(late):  # a name begins at its first letter
        letters = ragged(start[late], end[late] - start[late])
        letters = letters[kind[letters] == 1]
        start[late] = np.append(letters, len(data))[np.searchsorted(letters, start[late])]
        start, end = start[start < end], end[start < end]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    names = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
    return names.indices.to_numpy(), names.dictionary.to_pylist(), np.searchsorted(start, begins)


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of the next."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


class _Terms:
    """Terms by number, with their hashes and their place among the terms asked for (or -1)."""

    def __init__(self, asked: list[str]) -> None:
        self.asked = {t.encode(): i for i, t in enumerate(asked)}
        self.appended = _appended()
        self.forget()

    def forget(self) -> None:
        self.numbers, self.of_identifier, self.of_word, self.texts = {}, {}, {}, []
        self.crc, self.crc_joined, self.length, self.place = array("I"), array("I"), array("q"), array("q")

    def number(self, term: bytes) -> int:
        n = self.numbers.get(term)
        if n is None:
            n = self.numbers[term] = len(self.texts)
            self.texts.append(term)
            self.crc.append(zlib.crc32(term))
            self.crc_joined.append(zlib.crc32(term + b"_"))
            self.length.append(len(term))
            self.place.append(self.asked.get(term, -1))
        return n

    def identifier(self, name: bytes) -> tuple[int, ...]:
        means = lambda w: len(w) > 1 and w not in _NOISE
        low = name.lower()
        found = [low] if means(low) else []
        if b"_" in name or (low != name and _CAMEL.search(name)):
            parts = [p.lower() for p in _CAMEL.sub(b"_", name).split(b"_") if p]
            if len(parts) > 1 or parts and parts[0] != low:
                found += filter(means, parts)
        return tuple(map(self.number, found))

    def word(self, name: bytes) -> tuple[int, ...]:
        low = name.lower()
        return (self.number(low),) if len(low) > 1 and low not in _STOP else ()

    def _found(self, texts: list[bytes], kinds: np.ndarray, known: dict, make) -> tuple[np.ndarray, np.ndarray]:
        """(terms in order, how many each text has)."""
        codes, names, at = _names(texts, kinds)
        of = []
        for name in names:
            terms = known.get(name)
            if terms is None:
                terms = known[name] = make(name)
            of.append(terms)
        count = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter(chain.from_iterable(of), np.int64, int(count.sum()))
        each = count[codes]
        upto = np.concatenate([[0], np.cumsum(each)])
        return flat[ragged((np.cumsum(count) - count)[codes], each)], np.diff(upto[at])

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how many each text has): ``functions.text.code_terms`` of each text."""
        if len(self.texts) > REMEMBERED or len(self.of_identifier) > REMEMBERED:
            self.forget()
        terms, count = self._found(texts, _IN_IDENTIFIER, self.of_identifier, self.identifier)
        said = [_said(t) for t in texts]
        if any(said):
            more, extra = self._found(said, _IN_WORD, self.of_word, self.word)
            rows = np.arange(len(texts))
            order = np.argsort(np.concatenate([np.repeat(rows, count), np.repeat(rows, extra)]), kind="stable")
            terms, count = np.concatenate([terms, more])[order], count + extra
        return terms, count

    def hashed(self, terms: np.ndarray, count: np.ndarray, dim: int) -> np.ndarray:
        """Sums of signs by text and bucket: of the terms, and of the adjacent pairs joined by _."""
        crc, joined, length = np.array(self.crc, np.uint32), np.array(self.crc_joined, np.uint32), np.array(self.length)
        row = np.repeat(np.arange(len(count)), count)
        pair = np.flatnonzero(row[1:] == row[:-1])
        before, after = joined[terms[pair]], terms[pair + 1]
        long = length[after]
        at = np.minimum(long, _LONGEST)
        both = crc[after]
        for k in range(4):
            both ^= self.appended[at, k, (before >> np.uint32(8 * k)) & 255]
        for i in np.flatnonzero(long > _LONGEST):
            both[i] = zlib.crc32(self.texts[after[i]], int(before[i]))
        h, row = np.concatenate([crc[terms], both]).astype(np.int64), np.concatenate([row, row[pair]])
        return np.bincount(row * dim + h % dim, ((h >> 16) & 1) * 2.0 - 1, len(count) * dim).reshape(-1, dim)

    def counted(self, terms: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place among the terms asked for, occurrences), in this order."""
        place, row = np.array(self.place, np.int64)[terms], np.repeat(np.arange(len(count)), count)
        key, n = np.unique((row * len(self.asked) + place)[place >= 0], return_counts=True)
        return key // max(1, len(self.asked)), key % max(1, len(self.asked)), n


def hashed_vectors(texts: list[list[str]], dim: int) -> np.ndarray:
    """``dense.HashingEmbedder`` of a few ids, a row an id; an id has one text or more."""
    terms, found = _Terms([]), np.zeros((len(texts), dim))
    for i, own in enumerate(texts):
        if own:
            x = terms.hashed(*terms.of([t.encode() for t in own]), dim).sum(0)
            y = np.sign(x) * np.log1p(np.abs(x))
            found[i] = y / (np.linalg.norm(y) or 1)
    return found


def _said(text: bytes) -> bytes:
    """``functions.text.comments_and_strings``."""
    found = _BLOCK.findall(text) if b"/*" in text else []
    if b'"' in text or b"'" in text:
        found = found + _STRING.findall(text)
    if b"#" in text or b"//" in text:
        found = found + [rest for _, rest in _LINE.findall(text)]
    return b"\n".join(found)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + most]), BYTES, "right")))
        yield batch.slice(at, n)
        at += n


def _lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def rows(docs: DataFrame, asked: list[str], dim: int, topics: bool, encoded: Column | None = None) -> DataFrame:
    """(doc_id, places, counts, n_terms, words, times, topics) of documents (doc_id, text).

    ``counts`` are the hashed vector's sums of signs at ``places``, ``times`` the
    occurrences of the asked terms numbered ``words``, ``topics`` the topic vector at
    length 1 (empty unless wanted). Where the text ``encoded`` is not null, that is hashed.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((asked, ascii_table(spark) if topics else None))
    kind, short = docs.schema["doc_id"].dataType.simpleString(), dim <= 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(shared.value[0])
        for batch in batches:
            for part in _parts(batch, max(1, min(TEXTS, NUMBERS // dim))):
                texts, n = [t or b"" for t in part.column(1).to_pylist()], part.num_rows
                found, count = terms.of(texts)
                text_of, word, times = terms.counted(found, count)
                other = part.column(2).to_pylist()
                if any(t is not None for t in other):
                    sums = terms.hashed(*terms.of([t if o is None else o for t, o in zip(texts, other)]), dim)
                else:
                    sums = terms.hashed(found, count, dim)
                row, place = np.nonzero(sums)
                tags = np.log1p(topic_counts(texts, shared.value[1])) if topics else np.zeros((n, 0))
                length = np.sqrt((tags * tags).sum(1, keepdims=True))
                tags = tags / np.where(length == 0, 1, length)
                columns = [
                    part.column(0),
                    _lists(row, place, n, pa.int16() if short else pa.int32()),
                    _lists(row, sums[row, place].astype(np.int32), n, pa.int32()),
                    pa.array(count, pa.int64()),
                    _lists(text_of, word, n, pa.int32()),
                    _lists(text_of, times, n, pa.int32()),
                    _lists(np.repeat(np.arange(n), tags.shape[1]), tags.ravel(), n, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "places", "counts", "n_terms", "words", "times", "topics"])

    second = F.lit(None).cast("binary") if encoded is None else encoded.cast("binary")
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"), second.alias("encoded"))
    return read.mapInArrow(run, f"doc_id {kind}, places array<{'smallint' if short else 'int'}>, counts array<int>, n_terms long, words array<int>, times array<int>, topics array<double>")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = terms = 0
    df = np.zeros(0, np.int64)
    for batch in batches:
        n, terms = n + batch.num_rows, terms + (pc.sum(batch.column(0)).as_py() or 0)
        more = np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        more[: len(df)] += df
        df = more
    words = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(words, -1)), pa.array(np.append(df[words], n)), pa.array(np.append(np.zeros(len(words), np.int64), terms))], ["word", "n", "terms"])


def statistics(found: DataFrame, asked: int) -> tuple[np.ndarray, int, float]:
    """(documents with each asked term, documents, mean number of terms, 1 if that is 0)."""
    sums = found.select("n_terms", "words").mapInArrow(_totals, "word long, n long, terms long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).collect()  # a row a term asked for
    df, n, terms = np.zeros(asked), 0, 0
    for r in sums:
        if r["word"] < 0:
            n, terms = r["n"], r["terms"]
        else:
            df[r["word"]] = r["n"]
    return df, n, terms / n if n and terms else 1.0
