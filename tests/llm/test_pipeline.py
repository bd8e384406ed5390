"""The pipeline, stage by stage, against brute force."""

import re

import corpus_pipeline
from siltseek.llm import toxicity
from siltseek.llm.scratch import scratch
from tests.llm import brute
from tests.llm.test_operators import check_packing, reference_ids, rows_of


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def step(name, df):
        out = scratch(dict(corpus_pipeline.STAGES)[name](spark, df, sf), name)
        assert name == "packing" or out.columns == columns
        return out

    clean = step("toxicity", docs)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert {i for i, _ in rows_of(clean)} == {i for i, s in scores.items() if s < 0.5}

    single = step("exact_dedup", clean)
    first = {}
    for i, t in rows_of(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    assert {i for i, _ in rows_of(single)} == set(first.values())

    far = step("near_dedup", single)
    rows = rows_of(single)
    assert {i for i, _ in rows_of(far)} == {i for (i, _), (_, c) in zip(rows, brute.near_components(rows, 5, 80)) if i == c}

    fresh = step("decontamination", far)
    leaks = {i for i, _ in brute.contaminated(rows_of(far), [(r.item_id, r.text) for r in items.collect()])}
    assert leaks and {i for i, _ in rows_of(fresh)} == {i for i, _ in rows_of(far)} - leaks

    rows = rows_of(fresh)
    ids = {i: [x] for (i, _), x in zip(rows, reference_ids([t for _, t in rows]))}
    packed = step("packing", fresh).collect()
    check_packing(packed, ids, 2048)
    assert len(packed) == corpus_pipeline.run(spark, sf).count()


def test_stages_on_odd_rows(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    kept = odd
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch(stage(spark, kept, sf), name)
        assert kept.columns == odd.columns and {r.a for r in kept.collect()} == {"x"}
        found[name] = {(r.doc_id, r.text) for r in kept.collect()}
    every = {(r.doc_id, r.text) for r in odd.collect()}
    assert {t for _, t in found["toxicity"]} >= {None, ""}  # what says nothing is clean
    exact = found["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    firsts = {}
    for i, t in sorted(found["toxicity"], key=lambda r: (r[0] is None, r[0])):
        firsts.setdefault(norm(t), i)
    assert {(norm(t), i) for i, t in exact} == set(firsts.items())
    assert found["near_dedup"] <= exact <= every and {norm(t) for _, t in found["near_dedup"]} >= {""}
    assert found["decontamination"] <= found["near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    ids = {}
    for r, i in zip(kept.collect(), reference_ids([r.text or "" for r in kept.collect()])):
        ids.setdefault(r.doc_id, []).append(i)
    check_packing(packed, ids, 2048)
    assert {r.doc_id for r in packed} == set(ids)
