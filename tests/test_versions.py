import pytest

from siltseek.plans.retriever import HybridRetriever
from siltseek.plans.versioned import VersionedIndex
from siltseek.sources.config import PipelineConfig

A1, A2 = "function clean(x) {\n  return x.trim();\n}", "function clean(x) {\n  return x.trim().toLowerCase();\n}"
B = "function route(x) {\n  return pick(x);\n}"
C = "function hidePassword(line) {\n  return mask(line);\n}"


@pytest.fixture(scope="module")
def index(spark):
    v = VersionedIndex(HybridRetriever(PipelineConfig(model="hashing")))
    frame = lambda d: spark.createDataFrame([(k, t, f"{k}:1") for k, t in d.items()], "sid string, text string, location string")
    stats = [v.add_version(n, frame(d)) for n, d in (("v1", {"a": A1, "b": B}), ("v2", {"a": A2, "b": B, "c": C}), ("v3", {"a": A2, "b": B + "  \n", "c": C}))]
    return v, stats


def test_only_changes_are_new(index):
    assert [(s["snippets"], s["new_or_changed"], s["unchanged"]) for s in index[1]] == [(2, 2, 0), (3, 2, 1), (3, 0, 3)]


def test_one_version_and_latest(spark, index):
    q = spark.createDataFrame([("q", "where is the password hidden")], "qid string, text string")
    assert "c" not in [r.id for r in index[0].search(q, "v1").collect()]
    assert index[0].search(q).where("rank = 1").first().id == "c"


def test_all_versions_are_grouped(spark, index):
    q = spark.createDataFrame([("q", "clean and trim to lower case")], "qid string, text string")
    hits = {r.id: r for r in index[0].search(q, "all", 5).collect()}
    assert hits.keys() == {"a", "b", "c"}
    assert hits["a"].same_in_versions == ["v2", "v3"] and [x.version for x in hits["a"].changed_in_versions] == ["v1"]
    assert hits["b"].same_in_versions == ["v1", "v2", "v3"] and hits["b"].version == "v3"


def test_one_version_only_and_none(spark):
    v = VersionedIndex(HybridRetriever(PipelineConfig(model="hashing")))
    q = spark.createDataFrame([("q", "x")], "qid string, text string")
    with pytest.raises(ValueError):
        v.search(q)
    v.add_version("v1", spark.createDataFrame([("a", A1)], "sid string, text string"))
    assert v.search(q, "all").count() == 1
