"""Every operator against brute force, on awkward rows and on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltseek.llm import decontamination, exact_dedup, lm_scoring, near_dedup, packing, quality, repeated_windows, sharding, token_counts, toxicity
from siltseek.llm.components import components
from siltseek.llm.scratch import scratch
from tests.llm import brute
from tests.llm.conftest import CLASHES, awkward_rows, make


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0]))


# ---- exact dedup ----


@pytest.mark.parametrize("fan_in,entries", [(2, 100), (4, 5), (8, 16_384)])
def test_exact_dedup(spark, sf, awkward, fan_in, entries):
    for df in (awkward, documents(spark, sf)):
        rows = rows_of(df)
        norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
        groups = {}
        for i, _ in rows:
            groups.setdefault(norm[i], []).append(i)
        got = exact_dedup.exact_dedup(df, fan_in=fan_in, entries=entries).collect()
        assert len(got) == len(rows)
        for r in got:
            g = groups[norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())


def test_runs_merge_in_binomial_rounds(spark):
    """After all rounds each digest is in one run, each run is sorted, and counts and smallest ids are whole."""
    rng = np.random.default_rng(3)
    rows = [(int(run), [(int(x), int(x).to_bytes(8, "big"), 1, int(x) % 97, int(rng.integers(1000)), 1, [int(run)]) for x in np.sort(rng.choice(500, 60, replace=False)) * ((1 << 60) // 500)]) for run in range(16)]
    df = spark.createDataFrame(rows, "run int, entries array<struct<lead: long, digest: binary, n_bytes: long, proof: long, first_id: long, n: long, runs: array<int>>>")
    want = {}
    for run, entries in rows:
        for lead, *_, first, n, _ in entries:
            first_id, total, runs = want.get(lead, (first, 0, []))
            want[lead] = (min(first, first_id), total + n, [*runs, run])
    for fan_in in (2, 4, 16):
        got = exact_dedup.merge_runs(df, fan_in, 16).collect()
        assert all([e.lead for e in r.entries] == sorted({e.lead for e in r.entries}) for r in got)
        flat = [e for r in got for e in r.entries]
        assert len(flat) == len(want) and {e.lead: (e.first_id, e.n, sorted(e.runs)) for e in flat} == want


def test_exact_dedup_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count() and exact_dedup.exact_dedup(empty).count() == 0
    six = [r for r in got if r.keep_id == 6]
    assert len(six) == 6 and {r.group_size for r in six} == {6} and sum(r.kept for r in six) == 3  # id 6 three times
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.where("n_chars > 500").collect()} >= {6, 9}
    assert {7, 8, 17} & {r.doc_id for r in kept.collect()} == set()


def test_exact_dedup_stays_native(spark, sf, monkeypatch):
    """No table that is written on the way, nor the result, has a Python stage or an RDD."""
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().toString())
    monkeypatch.setattr(exact_dedup, "scratch", lambda df, tag: (seen(df), scratch(df, tag))[1])
    seen(exact_dedup.exact_dedup(documents(spark, sf)))
    assert len(plans) >= 4 and not any(re.search("Python|Pandas|Arrow|ExistingRDD|ObjectConsumer|MapPartitions", p) for p in plans)


def test_dropped_rows_are_found_by_broadcast_and_by_shuffle(spark, odd, monkeypatch):
    from siltseek.llm import scratch as s

    kept = [sorted(map(str, exact_dedup.drop_exact_duplicates(odd).collect()))]
    monkeypatch.setattr(s, "GONE_ROWS", 0)
    kept.append(sorted(map(str, exact_dedup.drop_exact_duplicates(odd).collect())))
    assert kept[0] == kept[1]


def test_scratch_refuses_a_local_folder_on_a_cluster():
    from siltseek.llm.scratch import shared_folder

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Cluster:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


# ---- sharding ----


def greedy(items, capacity):
    """Best-fit-decreasing, one item at a time."""
    room, out = [], []
    for s in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out.append((s, i))
    return out, len(room)


def test_best_fit_decreasing_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        items = rng.integers(1, 60, rng.integers(1, 200)).tolist()
        histogram = list(zip(*np.unique(items, return_counts=True)))
        plan = sharding.best_fit_decreasing([(int(s), int(n)) for s, n in histogram], 100)
        want, bins = greedy(items, 100)
        assert len({b for _, _, b in plan}) == bins
        fills = lambda pairs: sorted(sum(s for s, b in pairs if b == k) for k in {b for _, b in pairs})
        assert fills([(s, b) for s, n, b in plan for _ in range(n)]) == fills(want)


def test_sharding(spark, sf, odd, empty):
    assert sharding.shard_documents(empty).count() == 0
    for df in (odd, documents(spark, sf)):
        got = sharding.shard_documents(df, 16).collect()
        rows = df.collect()
        assert len(got) == len(rows)
        size = sorted(len((r.text or "").encode()) + 1 for r in rows)
        assert sorted(r.size for r in got) == size
        by_crc = {}
        for r in got:
            by_crc.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert all(len(v) == 1 for v in by_crc.values())
        for k in range(16):
            slots = sorted(r.slot for r in got if r.shard == k)
            assert slots == list(range(len(slots)))
    totals = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(totals) - min(totals) <= 0.02 * max(totals) or max(totals) == max(r.size for r in got)
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)


# ---- tokens ----


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_encoder_equals_the_reference(spark, sf):
    from siltseek.llm.tokens import encoder

    texts = [t or "" for _, t in awkward_rows()] + [r.text for r in documents(spark, sf).collect()] + [" " * 300_000, "<|endoftext|> x", "\r\n\r\n  \n"]
    assert [encoder()(t) for t in texts] == reference_ids(texts)


def test_token_counts(spark, sf, odd, empty):
    assert token_counts.context_limits(token_counts.length_histogram(empty)).count() == 0
    for df, limits in ((odd, [7, 2048, 1 << 20]), (documents(spark, sf), [3, 100, 100])):
        lengths = [len(i) for i in reference_ids([r.text or "" for r in df.collect()])]
        got = token_counts.context_limits(token_counts.length_histogram(df), limits).collect()
        assert sorted(r.context_limit for r in got) == sorted({*lengths, *limits})
        for r in got:
            k = r.context_limit
            assert (r.n_docs, r.docs_within, r.docs_over) == (lengths.count(k), sum(x <= k for x in lengths), sum(x > k for x in lengths))
            assert (r.kept_tokens, r.total_tokens) == (sum(min(x, k) for x in lengths), sum(lengths))
            assert abs(r.quantile - r.docs_within / len(lengths)) < 1e-12
    asked = {r.context_limit for r in token_counts.op3_token_counts(spark, sf).select("context_limit").collect()}
    assert {1 << i for i in range(21)} <= asked and set(lengths) <= asked


def check_packing(got, ids_by_doc, capacity):
    rows = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    fill = {}
    for r in rows:
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= capacity
    assert sum(fill.values()) == sum(len(x) + 1 for ids in ids_by_doc.values() for x in ids)
    for r in rows:
        assert any(zlib.crc32(np.array([*ids, 0], "<u4")[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_by_doc[r.doc_id])
    return len(fill)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, sf, odd, empty, capacity):
    assert packing.pack_documents(empty).count() == 0
    for df in (odd, documents(spark, sf)):
        rows = df.collect()
        ids = {}
        for r, i in zip(rows, reference_ids([r.text or "" for r in rows])):
            ids.setdefault(r.doc_id, []).append(i)
        n = check_packing(packing.pack_documents(df, capacity).collect(), ids, capacity)
        total = sum(len(x) + 1 for v in ids.values() for x in v)
        assert n <= 1.02 * -(-total // capacity) + 1


def test_local_search_empties_bins():
    start = [packing.BinClass((60,), 30), packing.BinClass((40, 25), 30), packing.BinClass((35,), 30)]
    done, moves = packing.local_search(start, 100)
    assert moves and sum(c.bins for c in done) < 90 and all(c.fill <= 100 for c in done)
    count = lambda cs: sorted(s for c in cs for s in c.items * c.bins)
    assert count(done) == count(start)


@pytest.mark.parametrize("low,high", [(20, 40), (25, 55), (15, 60), (24, 50), (1, 100)])
def test_local_search_ends_at_a_local_optimum(low, high):
    """Fewer bins than the best-fit start, or the bound; and no exchange is left."""
    rng = np.random.default_rng(low)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(low, high, 5000), return_counts=True))}
    start = packing.best_fit_classes(counts, 100)
    done, moves = packing.local_search(start, 100)
    bound, n = packing.least_bins(counts, 100), sum(c.bins for c in done)
    assert bound <= n <= sum(c.bins for c in start)
    assert {s: sum(c.items.count(s) * c.bins for c in done) for s in counts} == counts
    under = [c for c in done if c.fill < 100]
    if n > bound:
        for a in under:
            for b in under:
                if b.fill >= a.fill and (a is not b or a.bins > 1):
                    assert packing._best_exchange(packing._Sums(a.items), packing._Sums(b.items), 100 - b.fill) is None
    if (low, high) in [(20, 40), (25, 55), (24, 50)]:
        assert moves and n < sum(c.bins for c in start)


def test_least_bins_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(40):  # against the fewest bins of all packings of a few pieces
        items = sorted(rng.integers(1, 21, rng.integers(1, 8)).tolist(), reverse=True)

        def fewest(i, rooms):
            if i == len(items):
                return len(rooms)
            options = [fewest(i + 1, [*rooms, 20 - items[i]])]
            options += [fewest(i + 1, [*rooms[:j], r - items[i], *rooms[j + 1 :]]) for j, r in enumerate(rooms) if r >= items[i]]
            return min(options)

        counts = {int(k): int(n) for k, n in zip(*np.unique(items, return_counts=True))}
        assert packing.least_bins(counts, 20) <= fewest(0, [])


# ---- near dedup ----


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 3), (900, 901), (902, 901), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    for one_task in (0, 1000):
        got = {r.node: r.component for r in components(df, one_task=one_task).collect()}
        assert got == {**dict.fromkeys([*range(61), 500], 0), **dict.fromkeys([900, 901, 902], 900)}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("group_nodes", [1000, 1])
def test_near_dedup(spark, sf, awkward, words, percent, group_nodes, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 2)
    monkeypatch.setattr(near_dedup, "PART_NODES", 3)
    for df in (awkward, documents(spark, sf)):
        rows = rows_of(df)
        want = brute.near_components(rows, words, percent)
        got = {r.doc_id: r for r in near_dedup.near_dedup(df, words, percent, group_nodes=group_nodes).collect()}
        assert len(got) == len(rows)
        for (i, _), (n, c) in zip(rows, want):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i)


def test_near_dedup_chain_of_links(spark):
    """Neighbours are linked, ends are not: the component is found through the middle."""
    w = [f"w{i}" for i in range(400)]
    rows = [(10 - k, " ".join(w[12 * k : 12 * k + 200])) for k in range(8)]
    want = brute.near_components(rows, 3, 85)
    assert len({c for _, c in want}) == 1
    for group_nodes in (1000, 1):
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(make(spark, rows), 3, 85, group_nodes=group_nodes).collect()}
        assert got == {i: c for (i, _), (_, c) in zip(rows, want)}


def test_boilerplate_makes_no_candidate_groups(spark, monkeypatch):
    """A third of every text is the same; near copies among them are found, and the groups hold little else."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(5000)])
    common = rng.choice(words, 60).tolist()
    rows = []
    for i in range(1500):
        own = rng.choice(words, 120).tolist()
        rows.append((i, " ".join([*common, *own])))
        if i % 10 == 0:
            own[7] = "changed"
            rows.append((5000 + i, " ".join([*common, *own])))
    sizes = []

    def counted(links):
        found = scratch(components(links), "counted")
        sizes.extend(r["count"] for r in found.groupBy("component").count().collect())
        return found

    monkeypatch.setattr(near_dedup, "components", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(make(spark, rows), 3, 85).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert len(sizes) <= 170 and max(sizes) <= 4


def test_meetings_lead_as_long_as_nodes_follow_none():
    rng = np.random.default_rng(10)
    sig = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    sig[3] = sig[1]
    sig[4] = sig[1]
    sig[4, 0] ^= np.uint64(0xFFFF)  # eight pieces differ
    nodes = np.array([10, 11, 12, 13, 14, 10])
    a, b, firm, lead = near_dedup.meetings(np.array([7, 7, 7, 7, 7, 9], np.uint64), nodes, sig, 60, 50)
    assert set(zip(a.tolist(), b.tolist(), firm.tolist())) == {(11, 13, True), (11, 14, False)}
    assert set(lead) == {0, 1, 2, 4, 5}  # one follows; the key of one node leads alone


def test_near_dedup_odd_rows(spark, odd, empty):
    assert near_dedup.near_dedup(empty).count() == 0
    got = near_dedup.near_dedup(odd).collect()
    assert len(got) == odd.count()
    assert all(r.kept for r in got if r.n_shingles == 0)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {6, 11, 12} <= {r.doc_id for r in kept.collect()} and not {7, 8, 10} & {r.doc_id for r in kept.collect()}


# ---- repeated windows ----


def test_results_equal_their_sql(spark, sf):
    """op4 and op7 on the smallest tables, in DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for query, sql in ((near_dedup.op4_near_dedup, near_dedup.OP4_SQL), (repeated_windows.op7_repeated_windows, repeated_windows.OP7_SQL)):
        got, want = query(spark, sf), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


@pytest.mark.parametrize("spread", [2, 4096])
def test_repeated_windows(spark, sf, awkward, spread):
    for df in (awkward, documents(spark, sf)):
        rows = rows_of(df)
        want = brute.removed_windows(rows)
        got = repeated_windows.remove_repeats(df, spread=spread).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]


def test_repeated_windows_spread_and_slices(spark):
    """Grams with many different spans travel by window; long texts are scanned in slices."""
    passage = "the same long passage that very many documents share word for word, with a few more words to pass a hundred bytes. " * 2
    rows = [(i, f"start {i} of it {'x' * (i % 7)} " + passage + f" and end {i * 31} here") for i in range(40)]
    want = brute.removed_windows(rows)
    for spread in (3, 4096):
        got = repeated_windows.remove_repeats(make(spark, rows), spread=spread).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == want
    data = np.frombuffer(("".join(t for _, t in rows) * 3).encode(), np.uint8)
    whole = repeated_windows.spans(data, np.array([0, len(data)]))
    cut = repeated_windows.sliced_spans(data, np.array([0, len(data)]), 100, limit=500)
    windows = lambda s: sorted(w for a, m in zip(s["at"], s["more"]) for w in range(a, a + int(m) + 1))
    assert windows(whole) == windows(cut) == list(range(len(data) - 99))


def test_a_passage_in_every_document_is_no_tasks_alone(spark, monkeypatch):
    """The grams at a common passage's ends stand in as many different spans as there are documents."""
    rng = np.random.default_rng(12)
    passage = "a passage that stands in every document of the corpus, word for word, between texts that differ all over. " * 2
    noise = lambda: bytes(rng.integers(97, 123, 150).tolist()).decode()
    rows = [(i, noise() + " " + passage + noise()) for i in range(600)]
    written = {}
    monkeypatch.setattr(repeated_windows, "scratch", lambda df, tag: written.setdefault(tag, scratch(df, tag)))
    got = repeated_windows.remove_repeats(make(spark, rows), spread=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got} == brute.removed_windows(rows)
    most = lambda tag: np.unique(np.concatenate([np.frombuffer(r.h, "<u8") for r in written[tag].where("key IS NULL").collect()]), return_counts=True)[1].max()
    # a window is an entry of a cell at most, as its gram was of a document
    assert most("entries") >= 500 and most("cells") <= repeated_windows.CELLS


def test_repeated_windows_odd_rows(odd, empty):
    assert repeated_windows.remove_repeats(empty).count() == 0
    got = repeated_windows.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_removed for r in got if r.doc_id == 6} == {0} and {r.n_removed for r in got if r.doc_id == 7} == {len(awkward_rows()[6][1])}


# ---- decontamination ----


def test_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for df in (documents(spark, sf),):
        want = brute.contaminated(rows_of(df), [(r.item_id, r.text) for r in items.collect()])
        got = decontamination.contaminated(df, items).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_decontamination_edited_short_and_odd(spark, odd, empty):
    base = odd.where("doc_id = 6").first().text.split()
    noisy = base[30:60]
    noisy[15] = "other"
    items = spark.createDataFrame([(1, " ".join(base[10:50])), (2, "one two"), (3, ""), (4, None), (None, "x"), (5, " ".join(noisy)), (6, " ".join(base[:5] + ["q"] * 20)), (7, " ".join(base[100:]) + " unseen words that are nowhere else at all")], "item_id long, text string")
    rows = rows_of(odd)
    want = brute.contaminated(rows, [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    got = decontamination.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(6, 1), (7, 1), (10, 1), (6, 5), (5, 2)} <= want and not {i for _, i in want} & {3, 4, 6, 7}
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(odd, items.limit(0)).count() == 0
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect() if r.doc_id} == {i for i, _ in rows if i} - {i for i, _ in want}


def test_decontamination_in_groups_is_as_in_one(spark, monkeypatch):
    """A short item parted by other words is found in passages of the longest item, whatever its group."""
    short = [[f"s{i}w{j}" for j in range(16)] for i in range(12)]
    items = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(short)), (99, " ".join(f"l{j}" for j in range(200)))], "item_id long, text string")
    docs = make(spark, [(i, " ".join([*w[:8], *w[:8], *["filler"] * 60, *w[4:]])) for i, w in enumerate(short)])
    rows = lambda: sorted(tuple(r) for r in decontamination.contaminated(docs, items).collect())
    one = rows()
    assert [(r[0], r[1]) for r in one] == [(i, i) for i in range(12)]
    monkeypatch.setattr(decontamination, "GROUP_BYTES", 400)
    assert rows() == one and decontamination.drop_contaminated(docs, items).count() == 0


def test_postings_of_pruned_blocks_are_not_read():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    index = decontamination.build_index(list(range(40)), [" ".join(rng.choice(words, 12)) for _ in range(40)], [None] * 40)
    terms, n_blocks = np.arange(0, len(index.vocabulary), 3), index.block_most.shape[1]
    every = decontamination.postings(index, terms, np.arange(n_blocks))
    assert len(every) == sum(index.first[t, -1] - index.first[t, 0] for t in terms) == len(set(every))
    some = np.array([1, 4])
    assert sorted(decontamination.postings(index, terms, some)) == sorted(p for p in every if index.item[p] // index.block in some)


@pytest.mark.parametrize("group_bytes", [2 << 20, 400])
def test_decontamination_equals_its_sql(spark, sf, group_bytes, monkeypatch):
    """With one group of items and with several; short items too."""
    import duckdb

    monkeypatch.setattr(decontamination, "GROUP_BYTES", group_bytes)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(6).collect()]
    rows = rows_of(documents(spark, sf))
    items += [(100, "it"), (101, " ".join(rows[5][1].split()[3:6])), (102, " ".join(rows[7][1].split()[:40])), (103, "never to be found anywhere")]
    con = duckdb.connect()
    con.register("documents", documents(spark, sf).toPandas())
    con.register("benchmark", spark.createDataFrame(items, "item_id long, text string").toPandas())
    want = {tuple(r) for r in con.sql(decontamination.OP9_SQL).fetchall()}
    got = decontamination.contaminated(documents(spark, sf), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "shared", "total").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {100, 101, 102} <= {i for _, i, _, _ in want}


def test_question_and_answer_columns(spark):
    q, a = "which of the seven rivers runs north past the old town", "the green river runs north past the old town and on"
    items = spark.createDataFrame([(1, q, a)], "item_id long, q string, a string")
    docs = make(spark, [(1, q + " " + a), (2, q), (3, a)])
    assert {r.doc_id for r in decontamination.contaminated(docs, items, question_col="q", answer_col="a").collect()} == {1}


# ---- language model ----


def test_lm_base_scores(spark, sf, awkward):
    for df in (awkward, documents(spark, sf)):
        rows = rows_of(df)
        want = brute.unigram_scores(rows)
        got = lm_scoring.score_documents(df).collect()
        assert len(got) == len(rows)
        for r in got:
            held, n, known, total, base = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
            assert abs(r.base_score - base) <= 1e-9 * max(1, abs(base))
            assert np.isfinite(r.score) and r.score < 0


def test_lm_odd_rows(odd, empty):
    assert lm_scoring.score_documents(empty).count() == 0
    got = lm_scoring.score_documents(odd).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id == 6}) == 1
    assert {r.n_tokens for r in got if r.doc_id == 1} == {1}


def test_context_tree_is_a_distribution_and_weights_depths():
    from siltseek.llm import context_tree as ct

    text = ("ab" * 300 + "c").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    key, n = ct.grams(*ct.streams(data, offsets), 2)
    levels = []
    for d in (2, 1, 0):
        k = key & np.uint64((1 << 8 * (d + 1)) - 1)
        by = np.argsort(k)
        k, m = ct.summed(k[by], n[by])
        levels.insert(0, (k >> np.uint64(8), (k & np.uint64(255)).astype(int), m))
    tree = ct.build(levels)
    assert np.allclose((10.0 ** tree.cost.astype(float)).sum(1), 1, atol=1e-4)
    stream, at = ct.streams(data, offsets)
    assert -tree.score(stream, at)[0] / np.log10(2) / len(stream) < 0.2  # bits a byte of a period-2 text


def test_context_tree_equals_a_direct_weighting():
    """One depth, by the recursion itself, bit node by bit node."""
    from math import lgamma, log, pi

    from siltseek.llm import context_tree as ct

    rng = np.random.default_rng(1)
    symbols = {c: rng.multinomial(rng.integers(1, 50), np.ones(4) / 4) for c in (97, 98, 99)}
    kept = [97, 98]
    root = sum(symbols.values())
    level0 = (np.zeros(4, np.uint64), np.arange(97, 101), root)
    one = [(np.full(4, c, np.uint64), np.arange(97, 101), symbols[c]) for c in kept]
    tree = ct.build([level0, tuple(np.concatenate(x) for x in zip(*one))])
    block = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def split(counts, prefix, depth):
        m = [0, 0]
        for s, n in zip(range(97, 101), counts):
            if s >> (8 - depth) == prefix:
                m[(s >> (7 - depth)) & 1] += n
        return m

    for context, leaf in ((97, symbols[97]), (120, symbols[99])):  # the latter is the rest
        for byte in (97, 100):
            total = 0.0
            for depth in range(8):
                prefix, bit = byte >> (8 - depth), (byte >> (7 - depth)) & 1
                own, parts = split(root, prefix, depth), [split(symbols[c], prefix, depth) for c in symbols]
                children = sum(block(*p) for p in parts)
                weight = 1 / (1 + np.exp(children - block(*own)))
                estimate = lambda m: (m[bit] + 0.5) / (sum(m) + 1)
                total += np.log10(weight * estimate(own) + (1 - weight) * estimate(split(leaf, prefix, depth)))
            state = int(tree.step[0, context])
            assert abs(tree.cost[state, byte] - total) < 1e-4


def test_lm_tree_holds_every_context(spark, monkeypatch):
    """More contexts than any fixed number of states: the scores are those of the whole tree."""
    from siltseek.llm import context_tree as ct

    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 350).tolist()).decode() for _ in range(49)]
    own = [i for i in range(49) if zlib.crc32(str(i).encode()) % 7 != 2]
    block = lambda ids: (np.frombuffer("".join(texts[i] for i in ids).encode(), np.uint8), np.arange(len(ids) + 1) * 350)
    key, n = ct.grams(*ct.streams(*block(own)), 5)
    levels = []
    for d in range(5, -1, -1):
        k = key & np.uint64((1 << 8 * (d + 1)) - 1)
        by = np.argsort(k)
        k, m = ct.summed(k[by], n[by])
        levels.insert(0, (k >> np.uint64(8), (k & np.uint64(255)).astype(int), m))
    tree = ct.build(levels)
    assert len(tree.cost) > 32_768
    want = tree.score(*ct.streams(*block(range(49))))
    for share in (lm_scoring.HEAD_GRAMS, 0.01):  # all known grams are broadcast, or hardly any
        monkeypatch.setattr(lm_scoring, "HEAD_GRAMS", share)
        got = {r.doc_id: r.score for r in lm_scoring.score_documents(make(spark, list(enumerate(texts)))).collect()}
        assert np.allclose([got[i] for i in range(49)], want, rtol=1e-5)


def test_lm_scores_equal_brute_force(spark):
    """Context-tree weighting by its recursion, bit by bit and node by node, at depth 3."""
    words = ["ab", "abc", "b", "Ca", "cab"]
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(40)] + [(50, None), (51, "zz \t ab"), (52, "é")]
    want = brute.tree_scores(rows, 3)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(make(spark, rows), depth=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)


# ---- classifiers ----


def test_toxicity_learns_variants(spark):
    rng = np.random.default_rng(2)
    plain = ["river", "stone", "window", "garden", "market", "letter", "summer", "friend"]
    bad = ["grobnik", "grobniks", "grobnikish"]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(plain, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            w[5], w[15] = (bad[i % 3], "grobnikly") if zlib.crc32(str(i).encode()) % 5 == 0 else (bad[i % 3], bad[(i + 1) % 3])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, y = make(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, y)).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, y))
    assert kept.columns == docs.columns and 250 <= kept.count() <= 320


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, empty, module, name):
    score = module.score_toxicity if name == "toxic" else module.score_quality
    one_class = spark.createDataFrame([(6, 1), (9, 1), (None, 0), (11, None)], f"doc_id long, {name} int")
    two = spark.createDataFrame([(6, 1), (9, 1), (7, 1), (8, 0), (11, 0), (12, 0), (12, 0), (99, 1)], f"doc_id long, {name} int")
    for labels in (one_class, two, two.limit(0)):
        got = score(odd, module.fit(odd, labels)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert score(empty, module.fit(empty, labels)).count() == 0


def test_labelled_sample_keeps_both_classes(spark):
    from siltseek.llm.labelled import labelled_sample

    docs = make(spark, [(i, ("t" if i % 20 == 0 else "c") * 1000) for i in range(400)] + [(i, "t" * 90_000) for i in range(400, 420)])
    y = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(400)] + [(i, 1) for i in range(400, 420)], "doc_id long, toxic int")
    count = lambda *a: [labelled_sample(*a).column("label").to_pylist().count(c) for c in (0, 1)]
    clean, toxic = (sum(zlib.crc32(str(i).encode()) % 5 != 0 and (i % 20 == 0) == t for i in range(400)) for t in (False, True))
    # in one hash order of both classes, or with a stop at the first long text, few toxic ones or none are left
    assert count(docs, y, "toxic", 2000, 60_000) == [60 - toxic, toxic]
    assert count(docs.where("doc_id < 400"), y, "toxic", 2000, 1 << 20) == [clean, toxic]
    with pytest.raises(ValueError, match="class 1"):
        labelled_sample(docs.where("doc_id >= 400 OR doc_id % 20 > 0"), y, "toxic", 2000, 60_000)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    y = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op5_quality(spark, sf).join(y, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_clashing_names_are_there(awkward):
    assert set(CLASHES) <= set(awkward.columns)


class _FewRows:
    """Stands for a model; a worker must not get many whole texts at once."""

    def score(self, data, offsets):
        assert len(offsets) - 1 <= 1000
        return np.zeros(len(offsets) - 1)


def test_drop_toxic_gets_few_whole_texts_at_a_time(spark):
    docs = make(spark, [(i, "some words") for i in range(2500)]).coalesce(1)
    assert toxicity.drop_toxic(docs, _FewRows()).count() == 2500


def test_quality_learns_from_every_labelled_document(spark):
    n, width = 3000, quality._WIDTH
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(n, width)), (np.arange(n) % 30 != 0).astype(int)
    x[:, 0] += label
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(n)], "_id long, label int, x array<double>")
    blocks = [(r.block, r.label, r.x[1]) for r in quality.blocks_of(rows, int(label.sum()), int(n - label.sum())).collect()]
    assert {v for _, _, v in blocks} == set(x[:, 1])  # 2,900 good texts were cut to 2,000
    assert {b for b, y, _ in blocks if y == 0} == {b for b, y, _ in blocks if y == 1} == set(range(6))
    model = quality.train(rows)
    ranks = np.sort(model.rank(x))
    assert abs((ranks[99] + ranks[100]) / 2 - (float(np.log(quality.CUT / (1 - quality.CUT))) - model.shift)) < 1e-9
    assert model.rank(x)[label == 1].mean() > model.rank(x)[label == 0].mean()
