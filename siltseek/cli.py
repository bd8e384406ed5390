"""python -m siltseek.cli search | history | demo | eval | tune | smoke"""

from __future__ import annotations

import argparse
import tempfile
import time
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltseek.functions.text import preview
from siltseek.operators.chunking import chunk_files, stable_ids
from siltseek.plans import evaluate
from siltseek.plans.retriever import HybridRetriever
from siltseek.plans.versioned import VersionedIndex
from siltseek.session import ship_package
from siltseek.sources.config import PipelineConfig, resolve
from siltseek.sources.harness import parse_version_specs, write_report
from siltseek.sources.repo import read_repo

#: The demo's three versions of a small program: file -> text.
DEMO = {
    "v1": {"src/input.js": "function cleanInput(text) {\n  return text.trim();\n}\n\nfunction route(text) {\n  return pick(cleanInput(text));\n}\n", "src/retry.js": "async function retry(task) {\n  return task();\n}\n"},
    "v2": {"src/input.js": "function cleanInput(text) {\n  return text.trim().toLowerCase();\n}\n\nfunction route(text) {\n  return pick(cleanInput(text));\n}\n", "src/retry.js": "async function retry(task) {\n  return task();\n}\n", "src/log.js": "function hidePassword(line) {\n  return line.replace(/password=.*/, 'password=***');\n}\n"},
    "v3": {"src/input.js": "// input\nfunction cleanInput(text) {\n  return text.trim().toLowerCase();\n}\n\nfunction route(text) {\n  return pick(cleanInput(text));\n}\n", "src/retry.js": "async function retry(task, wait) {\n  // waits longer each time\n  try { return await task(); } catch (e) { await sleep(wait); return retry(task, wait * 2); }\n}\n", "src/log.js": "function hidePassword(line) {\n  return line.replace(/password=.*/, 'password=***');\n}\n"},
}
DEMO_QUERIES = ["How is the input cleaned before it is routed?", "Which code retries a failed task and waits longer each time?", "Where are passwords kept out of the logs?"]


def repo_snippets(spark: SparkSession, path: str | Path) -> DataFrame:
    """(sid, text, location) of a repository's snippets."""
    return stable_ids(chunk_files(read_repo(spark, path))).select("sid", "text", F.col("id").alias("location"))


def show(hits: DataFrame) -> None:
    rows = hits.withColumn("preview", preview("text")).orderBy("qid", "rank").collect()
    for h in rows:
        same = f"   best text is in: {', '.join(h['same_in_versions'])}" if h["same_in_versions"] else ""
        print(f"  {h['rank']}. {h['location'] or h['id']}   score {h['score']:.2f}{same}")
        for other in h["changed_in_versions"]:
            print(f"       also matched in {other['version']} with different text (score {other['score']:.2f})")
        print(h["preview"])


def _ask(spark: SparkSession, index: VersionedIndex, question: str, version: str, k: int) -> None:
    began = time.perf_counter()
    hits = index.search(spark.createDataFrame([("q", question)], "qid string, text string"), version, k)
    print(f"query: {question}   (version {version})")
    show(hits)
    print(f"  {time.perf_counter() - began:.1f} s\n")


def _judged(spark: SparkSession, config: PipelineConfig, a: argparse.Namespace) -> None:
    """eval, tune and smoke: a report is written and its main figures are printed."""
    data = evaluate.Collection.read(spark, a.corpus, a.queries, a.qrels)
    if a.command == "eval":
        report, _ = evaluate.evaluate(data, config)
        print("  ".join(f"{k} {v}" for k, v in report.items() if k != "config"))
    elif a.command == "tune":
        best, report = evaluate.tune(data, config, None, a.sample_queries, a.sample_docs, a.seed, a.tags)
        for row in report:
            print("  ".join(str(v) for v in row.values()))
        print(best.to_json())
        if a.write_config:
            write_report(a.write_config, asdict(best))
    else:
        report = evaluate.smoke(data, config)
        print(f"estimated full run: {report['estimated_full_run_minutes']} minutes")
    write_report(a.out, report)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siltseek")
    parser.add_argument("--config")
    parser.add_argument("--model", default="hashing")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("search")
    one.add_argument("--repo", required=True)
    many = sub.add_parser("history")
    many.add_argument("--versions", nargs="+", required=True, help="name=path, oldest first")
    for p in (one, many):
        p.add_argument("--top-k", type=int, default=5)
        p.add_argument("query")
    sub.add_parser("demo")
    for name, says in (("eval", "run_summary.json"), ("tune", "tuning_report.json"), ("smoke", "smoke_test_report.json")):
        p = sub.add_parser(name)
        for table in ("corpus", "queries", "qrels"):
            p.add_argument(f"--{table}", required=True, help="Parquet, or JSON lines if it ends in .json or .jsonl")
        p.add_argument("--out", default=says)
        if name == "tune":
            p.add_argument("--sample-queries", type=int, default=300)
            p.add_argument("--sample-docs", type=int, default=3000)
            p.add_argument("--seed", type=int, default=7)
            p.add_argument("--tags", action="store_true")
            p.add_argument("--write-config")
    a = parser.parse_args(args)

    spark = SparkSession.builder.appName("siltseek").getOrCreate()
    ship_package(spark)
    config: PipelineConfig = replace(resolve(Path.cwd(), a.config), model=a.model)
    if a.command in ("eval", "tune", "smoke"):
        _judged(spark, config, a)
        return
    index = VersionedIndex(HybridRetriever(config))

    def add(name: str, path: str | Path) -> None:
        s = index.add_version(name, repo_snippets(spark, path))
        print(f"{name}: {s['snippets']} snippets, {s['new_or_changed']} new or changed, {s['unchanged']} unchanged")

    if a.command == "search":
        add("current", a.repo)
        _ask(spark, index, a.query, "current", a.top_k)
    elif a.command == "history":
        for name, path in parse_version_specs(a.versions):
            add(name, path)
        _ask(spark, index, a.query, "all", a.top_k)
    else:
        with tempfile.TemporaryDirectory() as root:
            for version, files in DEMO.items():
                for name, text in files.items():
                    path = Path(root, version, name)
                    path.parent.mkdir(parents=True, exist_ok=True)
                    path.write_text(text)
                add(version, Path(root, version))
            for q in DEMO_QUERIES:
                _ask(spark, index, q, "v3", 2)
            _ask(spark, index, DEMO_QUERIES[0], "v1", 1)
            _ask(spark, index, DEMO_QUERIES[0], "all", 3)


if __name__ == "__main__":
    main()
