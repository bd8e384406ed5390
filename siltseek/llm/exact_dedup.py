"""Exact dedup: tree-merge of sorted digest runs (DataFrame operations only).

Each document's normalised text becomes a SHA-256 digest. Documents are dealt
into runs by a hash of their id; a run is one array of entries sorted by digest,
each digest once with its smallest id, its count and the runs it came from.
Runs then merge in binomial rounds: in round k the ``fan_in`` partners whose
numbers differ in digit k exchange slices, the partner with digit v taking the
slices whose digests have digit v there, and each merges what it gets. After the
last round every digest lies in one run. A run stays as long as it was (slices
go out as others come in), and a digest with a third of all rows is one entry of
each run, so ``fan_in`` entries of any merge.

A merge is ``sort_array`` over the concatenated slices: its sort looks for
ascending stretches first and merges those, so sorted slices are merged, not
sorted anew. Equal neighbours then become one entry. On the way down each final
entry names the runs it came from, and these tell their documents.

"Verified": the byte length and an independent 64-bit hash of the text are
compared with the digest at every level, so entries merge only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltseek.llm.scratch import drop_rows, scratch

#: Runs of the six ASCII white-space characters, but for a lone space (which its replacement leaves as it is).
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
KEY = ["digest", "n_bytes", "proof"]
#: Entries in a run, about; they travel as one row of some 100 bytes an entry.
ENTRIES = 16_384
#: Bits of ``lead``, the digest's first digits as a number.
_LEAD = 60
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def _same(x: Column, y: Column) -> Column:
    """Whether two entries (or none) are of one text."""
    return F.coalesce((x["lead"] == y["lead"]) & (x["digest"] == y["digest"]) & (x["n_bytes"] == y["n_bytes"]) & (x["proof"] == y["proof"]), F.lit(False))


def combined(entries: Column, most: int) -> Column:
    """Sorted entries with those of one text, at most ``most`` neighbours, as one; the smallest id is the first's."""

    def one(x: Column, i: Column) -> Column:
        equal = F.filter(F.slice(entries, i + 1, most), lambda y: _same(x, y))
        whole = F.struct(x["lead"].alias("lead"), *[x[c].alias(c) for c in KEY], x["first_id"].alias("first_id"), F.aggregate(equal, F.lit(0).cast("long"), lambda n, y: n + y["n"]).alias("n"), F.flatten(F.transform(equal, lambda y: y["runs"])).alias("runs"))
        merged = F.when(_same(x, F.get(entries, i + 1)), whole).otherwise(x)
        return F.when((i == 0) | ~_same(x, F.get(entries, i - 1)), merged)

    return F.filter(F.transform(entries, one), lambda x: x.isNotNull())


def merge_runs(leaves: DataFrame, fan_in: int, runs: int) -> DataFrame:
    """(run, entries) of ``runs`` sorted runs, a power of ``fan_in``, to runs that share no digest."""
    bits, level = fan_in.bit_length() - 1, leaves
    for k in range((runs.bit_length() - 1) // bits):
        digit = lambda x: F.shiftright(x["lead"], _LEAD - bits * (k + 1)).bitwiseAND(F.lit(fan_in - 1).cast("long"))  # noqa: E731, B023
        dealt = level.select("run", F.explode(F.sequence(F.lit(0), F.lit(fan_in - 1))).alias("v"), "entries")
        stride = fan_in**k
        partner = F.col("run") - F.expr(f"run div {stride} % {fan_in}") * stride + F.col("v") * stride
        slices = dealt.select(partner.cast("int").alias("run"), F.filter("entries", lambda x: digit(x) == F.col("v")).alias("slice")).where(F.size("slice") > 0)
        merged = slices.groupBy("run").agg(F.sort_array(F.flatten(F.collect_list("slice"))).alias("entries"))
        level = scratch(merged.select("run", combined(F.col("entries"), fan_in).alias("entries")), f"round{k}")
    return level


def _exact_dedup(docs: DataFrame, id_col: str, text_col: str, fan_in: int, entries: int) -> DataFrame:
    """``exact_dedup`` with the columns digest and proof instead of text_sha256."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    parts, runs = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("_t"))
    rows = scratch(rows.select("doc_id", F.unhex(F.sha2(F.col("_t"), 256)).alias("digest"), F.octet_length("_t").cast("long").alias("n_bytes"), F.xxhash64("_t").alias("proof")), "digests")
    while runs < max(parts, rows.count() // entries):
        runs *= fan_in
    rows = rows.withColumn("run", F.pmod(F.xxhash64(F.coalesce("doc_id", "proof")), F.lit(runs)).cast("int"))
    lead = F.conv(F.substring(F.hex("digest"), 1, _LEAD // 4), 16, 10).cast("long")
    own = rows.groupBy("run", *KEY).agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first_id"), F.count(F.lit(1)).alias("n"))
    entry = F.struct(lead.alias("lead"), *KEY, "first_id", "n", F.array("run").alias("runs"))
    leaves = scratch(own.groupBy("run").agg(F.sort_array(F.collect_list(entry)).alias("entries")), "leaves")
    final = merge_runs(leaves, fan_in, runs).select(F.explode("entries").alias("e")).where("e.n > 1")
    known = final.select(F.explode("e.runs").alias("run"), *[f"e.{c}" for c in KEY], F.col("e.first_id").alias("keep_id"), F.col("e.n").alias("group_size"))
    found = rows.join(known, ["run", *KEY], "left")  # a text that occurs once has no row in `known`
    keep = F.when(F.col("keep_id").isNull(), F.col("doc_id")).otherwise(F.nullif("keep_id", F.lit(_LAST)))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest", "proof").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, entries: int = ENTRIES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space.
    Of equal texts the smallest id stays. Defined cases: a null text is an
    empty text; a null id is larger than any id and stays only if the group has
    no other; a repeated (id, text) row counts in ``group_size`` and all rows
    with the surviving id are ``kept``; other columns are not read, so names
    cannot clash; an empty table gives an empty result.
    """
    done = _exact_dedup(docs, id_col, text_col, fan_in, entries)
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Null and empty texts are equal to each other, and one of them stays; of rows
    that repeat an id and text all stay or all go; a null id stays only where its
    text has no other id; an empty table stays empty.
    """
    gone = _exact_dedup(docs, id_col, text_col, 8, ENTRIES).where("NOT kept").select("doc_id", "proof", "digest")
    text = normalised(F.col(text_col))
    return drop_rows(docs, gone, F.col(id_col).cast("long"), F.xxhash64(text), F.unhex(F.sha2(text, 256)))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
