"""Whole runs over a small judged collection, and the command line that starts them."""

import json

import pytest

from siltseek import cli
from siltseek.operators import dense, metrics
from siltseek.plans import evaluate
from siltseek.plans.retriever import HybridRetriever
from siltseek.plans.versioned import VersionedIndex
from siltseek.sources.config import PipelineConfig

TEXTS = {
    "bfs": "def shortest_path(graph, start):\n    queue = [start]\n    return queue",
    "gcd": "def gcd(a, b):\n    while b:\n        a, b = b, a % b\n    return a",
    "sort": "def quick_sort(items):\n    return sorted(items)",
    "prime": "def sieve(n):\n    return [p for p in range(2, n) if is_prime(p)]",
}
ASKED = {"q1": ("find the shortest path in a graph", "bfs"), "q2": ("greatest common divisor gcd of a and b", "gcd"), "q3": ("sort the items quickly\n\n-----Input-----\nitems\n\n-----Examples-----\n3 2 1", "sort"), "q4": ("nothing is judged here", None)}


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("judged")
    spark.createDataFrame([(k, "", v) for k, v in TEXTS.items()], "id string, title string, text string").write.parquet(f"{d}/corpus")
    spark.createDataFrame([(k, v) for k, (v, _) in ASKED.items()], "id string, text string").write.parquet(f"{d}/queries")
    with open(d / "qrels.jsonl", "w") as f:
        f.writelines(json.dumps({"query-id": q, "corpus-id": a, "score": 1}) + "\n" for q, (_, a) in ASKED.items() if a)
    return [f"{d}/corpus", f"{d}/queries", f"{d}/qrels.jsonl"], d


@pytest.fixture(scope="module")
def data(spark, paths):
    return evaluate.Collection.read(spark, *paths[0])


def test_evaluate(data):
    summary, run = evaluate.evaluate(data, PipelineConfig(model="hashing"))
    assert summary["ndcg_at_10"] == summary["mrr_at_10"] == summary["recall_at_10"] == 1.0
    assert (summary["docs"], summary["queries"], summary["judged_queries"], summary["config"]["model"]) == (4, 4, 3, "hashing")
    assert run.count() == 16


def few_variants(monkeypatch):
    grid = metrics.default_grid()
    monkeypatch.setattr(metrics, "default_grid", lambda: [grid[0], grid[1]])


def test_the_grid_has_the_views_and_weights():
    grid = metrics.default_grid()
    assert len(grid) == 12 and {(g["w_full"], g["fusion"]) for g in grid} == {(1.0, "zscore"), (0.6, "zscore"), (0.6, "rrf")}


def test_tune_tries_variants_with_their_view_weights(data, monkeypatch):
    few_variants(monkeypatch)
    seen = []
    search = HybridRetriever.search
    monkeypatch.setattr(HybridRetriever, "search", lambda self, *a: (seen.append((self.config.w_full, self.config.fusion)), search(self, *a))[1])
    best, report = evaluate.tune(data, PipelineConfig(model="hashing"), n_queries=2, n_docs=3)
    assert len(report) == 2 and seen == [(1.0, "zscore"), (0.6, "zscore")]
    top = max(report, key=lambda r: r["ndcg_at_10"])
    assert isinstance(best, PipelineConfig) and best.model == "hashing" and 0 < top["ndcg_at_10"] <= 1


def test_smoke(data):
    report = evaluate.smoke(data, PipelineConfig(model="hashing"))
    assert (report["n_docs"], report["n_queries"]) == (4, 4) and len(report["tiny_search_top3"]) == 3
    assert report["versions"]["pyspark"] and report["sample_query_views"]["full_chars"] > 0


def test_commands(spark, paths, monkeypatch):
    (corpus, queries, qrels), d = paths
    monkeypatch.chdir(d)
    few_variants(monkeypatch)
    tables = ["--corpus", corpus, "--queries", queries, "--qrels", qrels]
    cli.main(["eval", *tables, "--out", f"{d}/run_summary.json"])
    assert json.loads((d / "run_summary.json").read_text())["ndcg_at_10"] == 1.0
    cli.main(["tune", *tables, "--sample-queries", "2", "--sample-docs", "3", "--out", f"{d}/tuning.json", "--write-config", f"{d}/configs/tuned.json"])
    assert len(json.loads((d / "tuning.json").read_text())) == 2
    assert PipelineConfig.load(f"{d}/configs/tuned.json").model == "hashing"


def test_transformer_with_a_stub_package(spark, tmp_path):
    """The plug-in, run with a package of the same interface."""
    (tmp_path / "sentence_transformers.py").write_text(
        "import numpy as np\n\nclass SentenceTransformer:\n"
        "    def __init__(self, name, device, trust_remote_code):\n        self.name, self.max_seq_length = name, 0\n"
        "    def encode(self, texts, batch_size, normalize_embeddings):\n"
        "        v = np.array([[len(t), t.count('a') + 1, self.max_seq_length] for t in texts], np.float32)\n"
        "        return v / np.linalg.norm(v, axis=1, keepdims=True)\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    e = dense.SentenceTransformerEmbedder("any/model", max_seq_length=7, query_prefix="query: ")
    df = spark.createDataFrame([(1, "banana"), (2, "kiwi")], "id long, text string")
    doc, query = ({r["id"]: r["vector"] for r in e.embed(df, kind).collect()} for kind in ("doc", "query_full"))
    assert doc.keys() == {"1", "2"} and abs(sum(x * x for x in doc["1"]) - 1) < 1e-6
    assert doc["1"] != query["1"] and abs(doc["1"][0] / doc["1"][2] - 6 / 7) < 1e-6
    found = HybridRetriever(PipelineConfig(model="any/model"), dense.SentenceTransformerEmbedder("any/model", max_seq_length=7))
    index = found.build_index(spark.createDataFrame([("x", "banana"), ("y", "kiwi kiwi kiwi")], "doc_id string, text string"))
    assert found.search(index, spark.createDataFrame([("q", "banana")], "qid string, text string"), 1).first().doc_id == "x"


def test_other_versions_keep_their_index(spark):
    v = VersionedIndex(HybridRetriever(PipelineConfig(model="hashing")))
    frame = lambda ids: spark.createDataFrame([(i, TEXTS[i]) for i in ids], "sid string, text string")
    q = spark.createDataFrame([("q", "gcd")], "qid string, text string")
    v.add_version("v1", frame(["bfs", "gcd"]))
    assert v.search(q, "v1").count() == 2 and v.search(q, "all").count() == 2
    first = v._indices["one", "v1"]
    v.add_version("v2", frame(["bfs", "gcd", "sort"]))
    assert v._indices == {("one", "v1"): first}
    assert v.search(q, "v1").count() == 2 and v.search(q, "all").count() == 3
