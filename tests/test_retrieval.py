import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltseek.functions import text as T, topics
from siltseek.operators import blocks, dense, features, fusion, lexical, metrics, pairs
from siltseek.plans.encoder import HarnessEncoder
from siltseek.plans.retriever import CodeIndex, HybridRetriever
from siltseek.sources.config import PipelineConfig, resolve

SNIPPETS = {
    "path": "def shortest(adj, s):\n    dist = {s: 0}\n    queue = deque([s])\n    # breadth first search over the graph\n    return dist\n",
    "gcd": "def gcd(a, b):\n    while b:\n        a, b = b, a % b\n    return a\n",
    "pal": "def is_palindrome(s):\n    return s == s[::-1]  # reverse the string\n",
    "sort": "def order(items):\n    return sorted(items)\n",
    "xor": "def lonely(xs):\n    out = 0\n    for x in xs:\n        out ^= x  # xor of all bits\n    return out\n",
    "sieve": "def primes(n):\n    sieve = [True] * n\n    return [i for i in range(2, n) if sieve[i]]\n",
}
ASKED = {"path": "shortest path in a graph", "gcd": "greatest common divisor gcd of two numbers", "pal": "is the string a palindrome", "xor": "the number that occurs once, with xor", "sieve": "prime numbers with a sieve"}


def docs(spark):
    return spark.createDataFrame(list(SNIPPETS.items()), "doc_id string, text string")


def asked(spark):
    return spark.createDataFrame(list(ASKED.items()), "qid string, text string")


def test_bm25_model(spark):
    terms = {"a": ["x", "y", "x"], "b": ["y"], "c": [], "d": ["z", "z"]}
    df = spark.createDataFrame(list(terms.items()), "doc_id string, terms array<string>")
    q = spark.createDataFrame([("q", ["x", "x", "y", "w"])], "qid string, terms array<string>")
    got = {r.doc_id: r.bm25 for r in lexical.scores(lexical.build(df), q).collect()}
    n, avg = 4, 6 / 4

    def score(ts):
        total = 0.0
        for t, qn in Counter(["x", "x", "y"]).items():
            tf, df_ = ts.count(t), sum(t in v for v in terms.values())
            if tf:
                total += (1 + math.log(qn)) * math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        return total

    assert got.keys() == {"a", "b"}
    assert all(abs(got[k] - score(terms[k])) < 1e-12 for k in got)
    only = {r.doc_id: r.bm25 for r in lexical.scores(lexical.build(df, only=q.select(F.explode("terms").alias("term"))), q).collect()}
    assert only == got


def test_hashing_model(spark):
    rows = dense.HashingEmbedder(64).embed(docs(spark).withColumnRenamed("doc_id", "id"), "doc").collect()
    terms = {r.doc_id: r.t for r in docs(spark).select("doc_id", T.code_terms("text").alias("t")).collect()}
    for id_, ts in terms.items():
        v = np.zeros(64)
        for g in ts + [f"{a}_{b}" for a, b in zip(ts, ts[1:])]:
            h = zlib.crc32(g.encode())
            v[h % 64] += 1 if (h >> 16) & 1 else -1
        v = np.sign(v) * np.log1p(np.abs(v))
        v /= np.linalg.norm(v) or 1
        got = np.zeros(64)
        for r in rows:
            if r.id == id_:
                got[r.bucket] = r.value
        assert np.allclose(got, v)


def test_search_finds_the_answer(spark):
    for kind in ("zscore", "rrf"):
        r = HybridRetriever(PipelineConfig(model="hashing", fusion=kind))
        run = r.search(r.build_index(docs(spark)), asked(spark), 3).collect()
        assert Counter(x.qid for x in run) == dict.fromkeys(ASKED, 3)
        assert sum(x.qid == x.doc_id for x in run if x.rank == 1) >= 4


def test_sparse_plan_equals_dense_plan(spark):
    r = HybridRetriever(PipelineConfig(model="hashing"))
    index = r.build_index(docs(spark))
    fast = {(x.qid, x.doc_id): (x.rank, x.score) for x in r.search(index, asked(spark), 6).collect()}
    z = fusion.zscored(r.all_scores(index, asked(spark)), ["dense", "bm25", "topic"])
    slow = fusion.top_k(z.withColumn("score", fusion.weighted({"z_dense": 1.0, "z_bm25": 0.25, "z_topic": 0.15})), 6).collect()
    assert len(fast) == len(slow) == 30
    assert all(abs(fast[x.qid, x.doc_id][1] - x.score) < 1e-9 for x in slow)


def test_prefix_and_permutation(spark):
    r = HybridRetriever(PipelineConfig(model="hashing"))
    q = asked(spark)
    a = {(x.qid, x.rank): x.doc_id for x in r.search(r.build_index(docs(spark)), q, 3).collect()}
    b = {(x.qid, x.rank): x.doc_id for x in r.search(r.build_index(docs(spark).orderBy(F.desc("doc_id"))), q, 4).collect()}
    assert all(b[k] == v for k, v in a.items())


def test_empty_corpus_and_no_questions(spark):
    r = HybridRetriever(PipelineConfig(model="hashing"))
    assert r.search(r.build_index(docs(spark).limit(0)), asked(spark), 3).count() == 0
    assert r.search(r.build_index(docs(spark)), asked(spark).limit(0), 3).count() == 0


def test_save_and_load(spark, tmp_path):
    r = HybridRetriever(PipelineConfig(model="hashing"))
    index = r.build_index(docs(spark))
    index.save(str(tmp_path / "i"))
    a, b = (r.search(i, asked(spark), 2).orderBy("qid", "rank").collect() for i in (index, CodeIndex.load(spark, str(tmp_path / "i"))))
    assert [(x.qid, x.doc_id) for x in a] == [(x.qid, x.doc_id) for x in b]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "x")], "qid string, rank int, doc_id string")
    qrels = spark.createDataFrame([("a", "y", 2.0), ("a", "w", 1.0), ("b", "q", 1.0), ("d", "x", 1.0)], "qid string, doc_id string, grade double")
    m = metrics.mean_metrics(run, qrels).first()
    ndcg = (2 / math.log2(3)) / (2 + 1 / math.log2(3))
    assert m.queries == 2 and abs(m.ndcg - ndcg / 2) < 1e-12 and m.mrr == 0.25 and m.recall == 0.25


def test_zero_scores_tie_by_id(spark):
    scores = spark.createDataFrame([("q", f"d{i}", 0.0) for i in range(5)], "qid string, doc_id string, s double")
    z = fusion.zscored(scores, ["s"])
    assert {r.z_s for r in z.collect()} == {0.0}
    assert [r.doc_id for r in fusion.top_k(z, 3, "z_s").orderBy("rank").collect()] == ["d0", "d1", "d2"]


def test_block_topk_and_moments(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id < 5").withColumnRenamed("doc_id", "qid")
    rows = e.collect()
    m = np.array([r.vector for r in rows], float)
    for r in dense.block_topk(q, e, 4).collect():
        x = m @ np.array(rows[r.qid].vector, float)
        assert abs(sorted(x)[-r["rank"]] - r.dense) < 1e-9
    for r in dense.block_moments(q, e).collect():
        x = m @ np.array(rows[r.qid].vector, float)
        assert abs(x.mean() - r["mean"]) < 1e-9 and abs(x.std() - r.sd) < 1e-6


def test_block_topk_and_moments_take_any_number_of_questions(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id < 11").withColumnRenamed("doc_id", "qid")
    for find, by in ((lambda x, n: dense.block_topk(x, e, 3, limit=n), ("qid", "rank")), (lambda x, n: dense.block_moments(x, e, limit=n), ("qid",))):
        one, many = (find(q, n).orderBy(*by).toPandas() for n in (4096, 4))
        assert one[list(by)].equals(many[list(by)]) and one.qid.nunique() == 11
        assert np.allclose(one.drop(columns="qid").to_numpy(float), many.drop(columns="qid").to_numpy(float), atol=1e-12)
        assert find(q.limit(0), 4).schema.names == list(one.columns) and find(q.limit(0), 4).count() == 0


def test_cache_encodes_once(spark, tmp_path):
    e = dense.build_cached(spark, "hashing", str(tmp_path / "c"))
    df = spark.createDataFrame([("1", "foo bar"), ("2", "foo bar"), ("3", "baz")], "id string, text string")
    ids = lambda x: {r.id for r in x.collect()}
    assert ids(e.embed(df, "doc")) == {"1", "2", "3"} and (e.misses, e.hits) == (2, 1)
    assert ids(e.embed(df, "doc")) == {"1", "2", "3"} and (e.misses, e.hits) == (2, 4)
    assert ids(e.embed(df, "query_full")) == {"1", "2", "3"} and e.misses == 4
    again = dense.build_cached(spark, "hashing", str(tmp_path / "c"))
    assert ids(again.embed(df, "doc")) == {"1", "2", "3"} and again.misses == 0


def test_cached_search_equals_plain_search(spark, tmp_path):
    cfg = PipelineConfig(model="hashing")
    runs = []
    for r in (HybridRetriever(cfg), HybridRetriever(cfg, dense.build_cached(spark, "hashing", str(tmp_path / "c")))):
        runs.append([(x.qid, x.doc_id, round(x.score, 9)) for x in r.search(r.build_index(docs(spark)), asked(spark), 3).orderBy("qid", "rank").collect()])
    assert runs[0] == runs[1]


def test_array_vectors(spark):
    """The retriever over vectors that a table has."""
    rng = np.random.default_rng(3)
    table = [(k, rng.normal(size=8).tolist()) for k in SNIPPETS]
    vectors = spark.createDataFrame(table, "id string, vector array<double>")
    r = HybridRetriever(PipelineConfig(bm25_weight=0.0, topic_weight=0.0), dense.ColumnEmbedder(vectors))
    q = spark.createDataFrame([(k, "x") for k in SNIPPETS], "qid string, text string")
    run = r.search(r.build_index(docs(spark)), q, 6).collect()
    m = np.array([v for _, v in table])
    x = m @ m.T
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    at = {k: i for i, (k, _) in enumerate(table)}
    assert len(run) == 36 and all(abs(z[at[r.qid], at[r.doc_id]] - r.score) < 1e-9 for r in run)


def test_stream_ingest(spark, tmp_path):
    from siltseek.streaming.ingest import ingest

    for i in range(2):
        spark.createDataFrame([(f"{i}", "same text"), (f"x{i}", f"text number{i}")], "id string, text string").write.parquet(str(tmp_path / f"in/{i}"))
    e = dense.build_cached(spark, "hashing", str(tmp_path / "c"))
    stream = spark.readStream.schema("id string, text string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ingest(stream, e, str(tmp_path / "ck")).awaitTermination()
    assert e.cache.read().count() == 3


def test_harness_encoder(spark):
    h = HarnessEncoder(HybridRetriever(PipelineConfig(model="hashing")))
    corpus = spark.createDataFrame([(k, "", v) for k, v in SNIPPETS.items()], "id string, title string, text string")
    h.index(corpus)
    q = spark.createDataFrame([(k, v, "") for k, v in ASKED.items()], "id string, text string, instruction string")
    assert h.search(q, 4).count() == 20
    listed = spark.createDataFrame([("gcd", "gcd"), ("gcd", "sort")], "qid string, doc_id string")
    cut = h.search(q, 1, listed).where("qid = 'gcd'").collect()
    assert [x.doc_id for x in cut] == ["gcd"]
    assert h.search(q, 2, listed, prefilter=True).where("qid = 'gcd'").count() == 2
    assert h.encode(corpus.select("id", "text")).count() > 0


def test_config(tmp_path):
    assert PipelineConfig.load({"fusion": "rrf", "unknown": 1}).fusion == "rrf"
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/default.json").write_text('{"bm25_weight": 0.5}')
    c = resolve(tmp_path, model="hashing")
    assert (c.bm25_weight, c.model, c.cache_path) == (0.5, "hashing", str(tmp_path / ".cache/embeddings.sqlite"))


def test_scores_equal_to_so_many_places_tie(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0 + 1e-12]), (3, [-1.0]), (4, [0.5])], "doc_id long, numbers array<double>")
    block = blocks.Questions(["q"], np.ones((1, 1)), np.zeros((1, 1)), (1.0, 0.0, 0.0))
    ranked = lambda digits: [r.doc_id for r in blocks.zscore_top_k(block, rows.coalesce(1), 2, digits).orderBy("rank").collect()]
    assert ranked(None) == [2, 1]
    assert ranked(9) == [1, 2]


def _pairs_tables(spark, n=60):
    """Documents of which every third is a copy of another, questions and their numbers."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 5)).astype(np.float32)
    v[::3] = v[0]
    label = rng.integers(0, 4, n)
    docs = spark.createDataFrame([(i, v[i].tolist(), int(label[i])) for i in range(n)], "doc_id long, vector array<float>, label int")
    asked = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("qid"), "vector", F.array("label").alias("wanted"))
    return docs.repartition(3), asked, v.astype(np.float64), label


def test_pairs_make_no_join_of_all_and_equal_vectors_tie(spark):
    docs, asked, v, label = _pairs_tables(spark)
    rows = pairs.best(asked, docs, 25)
    assert "CartesianProduct" not in (plan := rows._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    got = {(r.qid, r["rank"]): r.doc_id for r in rows.collect()}
    for q in range(0, 60, 7):
        dot = [sum(float(a) * float(b) for a, b in zip(v[q], x)) for x in v]
        assert [got[q, i + 1] for i in range(25)] == sorted(range(60), key=lambda d: (-dot[d], d))[:25]
    z = {(r.qid, r.doc_id): (r.z, r.m) for r in pairs.z_rows(asked, docs, ["z", "m"], 4).collect()}
    assert len(z) == 9 * 60
    for q in range(0, 60, 7):
        for x, i in ((v @ v[q], 0), ((label == label[q]) * 1.0, 1)):
            assert np.allclose([z[q, d][i] for d in range(60)], (x - x.mean()) / x.std(), atol=5.1e-5)


def test_ranks_by_label_and_what_may_be_among_the_best(spark):
    docs, _, _, label = _pairs_tables(spark)
    far = docs.withColumn("doc_id", F.col("doc_id") * 700)
    rows = far.withColumn("want", F.lit(2))
    got = {r.doc_id // 700: r.place_want for r in pairs.label_ranks(rows, far.select("doc_id", "label"), ["want"]).collect()}
    assert got == {d: i + 1 for i, d in enumerate(sorted(range(60), key=lambda d: (label[d] != 2, d)))}
    for others in ([0.25], [0.5, 0.15]):
        k = pairs.candidates([1.0, *others], 10, 60)
        assert 1 / (61 + k) + sum(others) / 61 < 1 / 70 <= 1 / (60 + k - 1) + sum(others) / 61
    assert pairs.candidates([1.0, 1.0], 10, 60) is None


def test_vectors_that_are_missing_score_null(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (3, [0.5, 0.0], None)], "doc_id long, vector array<float>, label int")
    asked = docs.where("doc_id = 1").select(F.col("doc_id").alias("qid"), "vector", F.array("label").alias("wanted"))
    assert [(r.doc_id, r.score) for r in pairs.best(asked, docs, 5).orderBy("rank").collect()] == [(1, 1.0), (3, 0.5), (2, None)]
    assert {r.doc_id: (r.z, r.m) for r in pairs.z_rows(asked, docs, ["z", "m"], 4).collect()} == {1: (1.0, 0.0), 2: (None, 0.0), 3: (-1.0, None)}
    assert pairs.best(asked.limit(0), docs, 5).collect() == []


def test_metrics_of_hits_are_those_of_judged_documents(spark):
    run = spark.createDataFrame([(0, q, r, 10 * q + r) for q in (1, 2) for r in range(1, 11)], "ordinal int, qid long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 13, 1.0), (1, 15, 1.0), (1, 99, 1.0), (2, 77, 1.0)], "qid long, doc_id long, grade double")
    want = metrics.mean_metrics(run, qrels, 10, ["ordinal"]).first()
    hits = run.join(qrels, ["qid", "doc_id"], "left").withColumn("hit", F.col("grade").isNotNull())
    got = metrics.mean_metrics_of_hits(hits, qrels.groupBy("qid").agg(F.count("*").alias("n")), 10, ["ordinal"]).first()
    assert abs(got.ndcg - want.ndcg) < 1e-12 and got.mrr == want.mrr and got.queries == want.queries == 2


#: What terms, hashing and topics must get right: boundaries, other scripts, cut matches, comments, a CR alone.
ODD = [
    "",
    "getHTTPResponse2 __init__ _x a_B 9lives 12_ab XMLHttp camelCase self None x1y2Z3",
    "ñandú graph éedges ſet K-heap dıjkstra vİsited adj bfs dfs deque \U0001d4b3graph graph́ a\x85t =\x0bint(",
    "lru_cachecache lru_cachelru_cache memo f[lru_cache][i] dp[ dp &xbit & bitmask && b & \x0bx ^<<>> LO 1 hi low high",
    "x = 5 % mod // gcd\n# a comment's words, twice twice\nprint('a \"string\" here', \"and it's\") /* block\nof the code */ '''long\none'''",
    "# one\rtwo three\r\n# four\rfive 'six\rseven' eight",
    "for _ in range(int(input())):\n for i in range(t):\n\tfor j in range(m):  \n\n\n\n\x0b  for k in range(n): grid[[ math. x.sort( sorted(",
    "a" * 70 + " " + "b" * 65 + " short " + "c" * 64,
    "word " * 900 + "tail\tend",
]


def test_terms_hashes_and_topics_are_those_of_the_columns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)
    want = df.select("id", T.code_terms("text").alias("terms"), topics.code_topics(F.col("text")).alias("topics")).orderBy("id").collect()
    data = [t.encode() for t in ODD]
    terms = features._Terms([])
    found, count = terms.of(data)
    assert [terms.texts[n].decode() for n in found] == [t for r in want for t in r.terms]
    assert list(count) == [len(r.terms) for r in want]
    assert np.allclose(np.log1p(features.topic_counts(data, features.ascii_table(spark))), [r.topics for r in want])
    assert features._Terms([]).of([b""])[1].tolist() == [0]
    vectors = features.hashed_vectors([[t] for t in ODD], 1 << 16)
    rows = dense.HashingEmbedder(1 << 16).embed(df, "doc").collect()
    assert len(rows) == np.count_nonzero(vectors) and all(abs(vectors[r.id, r.bucket] - r.value) < 1e-12 for r in rows)


def test_search_that_keeps_no_index_finds_what_an_index_does(spark, monkeypatch):
    texts = [*ODD, *SNIPPETS.values(), *ODD[1:4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame([*ASKED.items(), ("none", ""), ("view", "Sort the edges.\n-----Input-----\nOne word\n-----Note-----\nshort tail")], "qid string, text string")
    monkeypatch.setattr(blocks, "SHARES", 3)
    for change in ({}, {"augment_tags": True}, {"doc_max_chars": 1 << 30, "topic_weight": 0.0}, {"bm25_weight": 0.0}):
        r = HybridRetriever(PipelineConfig(model="hashing", **change))
        once = r.search_texts(df, questions, len(texts))
        assert "Generate" not in (plan := once._jdf.queryExecution().toString()) and "SortMergeJoin" not in plan
        got, want = ({(x.qid, x.doc_id): (x["rank"], x.score) for x in run.collect()} for run in (once, r.search(r.build_index(df), questions, len(texts))))
        assert got.keys() == want.keys() and len(got) == 7 * len(texts)
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
        for q in {q for q, _ in got}:  # copies tie, so the smaller id comes first
            assert all(got[q, i][0] < got[q, len(texts) - 4 + i][0] for i in (1, 2, 3))
    monkeypatch.setattr(blocks, "ASKED", 3)
    few = {(x.qid, x.doc_id): x.score for x in r.search_texts(df, questions, 4).collect()}
    assert len(few) == 28 and all(abs(got[k][1] - s) < 1e-9 for k, s in few.items())
    assert r.search_texts(df.limit(0), questions, 3).count() == r.search_texts(df, questions.limit(0), 3).count() == 0
