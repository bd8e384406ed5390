"""Source files to snippets: one per function or class, else line windows."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from siltseek.functions import lexicon as L
from siltseek.functions.text import strip

SIZE, OVERLAP = 40, 10
SNIPPET = "path string, seq long, ord int, id string, start int, end int, name string, text string"

_HEADERS = [re.compile(p) for p in L.JS_HEADERS]
#: What matters to brace matching; a plain string ends with its line, a template or block comment does not.
_LEXEME = re.compile(
    r"""//[^\n]* | /\*[\s\S]*?(?:\*/|\Z) | `(?:\\[\s\S]|[^`\\])*(?:`|\Z)
      | "(?:\\[^\n]|[^"\\\n])*(?:"|\\?(?=\n|\Z)) | '(?:\\[^\n]|[^'\\\n])*(?:'|\\?(?=\n|\Z)) | [(){}]""",
    re.VERBOSE,
)
#: A header's block must open no more than so many lines below it.
_OPENS_WITHIN = 4

Span = tuple[int, int, str]  # first and last line (0-based, inclusive), name


def _block_end(source: str, line_starts: list[int], first: int) -> int | None:
    """The line on which the block opened at line ``first`` closes.

    Braces in parentheses (defaults, destructuring) do not count.
    """
    braces = parens = 0
    opened = False
    for m in _LEXEME.finditer(source, line_starts[first]):
        mark = m.group()
        if mark == "(":
            parens += 1
        elif mark == ")":
            parens = max(0, parens - 1)
        elif mark in "{}" and not parens:
            line = bisect.bisect_right(line_starts, m.start()) - 1
            if not opened and line - first > _OPENS_WITHIN:
                return None
            opened = opened or mark == "{"
            braces += 1 if mark == "{" else -1
            if opened and mark == "}" and not braces:
                return line
    return None


def js_spans(source: str) -> list[Span]:
    """Functions, classes and methods; what is nested in a function is not listed again."""
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    spans: list[Span] = []
    at = 0
    while at < len(lines):
        names = (m.group(1) for m in (h.match(lines[at]) for h in _HEADERS) if m)
        name = next((n for n in names if n not in L.JS_NOT_NAMES), None)
        end = _block_end(source, starts[:-1], at) if name else None
        if end is None:
            at += 1
            continue
        spans.append((at, end, name))
        at = at + 1 if lines[at].lstrip().startswith(("class ", "export class ")) else end + 1
    return spans


def py_spans(source: str) -> list[Span]:
    """Functions and classes at any depth, decorators included; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    defs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    spans = [(min([d.lineno for d in n.decorator_list], default=n.lineno) - 1, (n.end_lineno or n.lineno) - 1, n.name) for n in defs]
    return sorted(spans, key=lambda s: (s[0], -s[1]))


def window_spans(source: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Span]:
    lines = source.split("\n")
    step = max(size - overlap, 1)
    last = max(0, -(-(len(lines) - size) // step)) * step
    cuts = [(i, min(i + size, len(lines)) - 1) for i in range(0, last + 1, step)]
    return [(a, b, f"lines {a + 1}-{b + 1}") for a, b in cuts if "".join(lines[a : b + 1]).strip()]


def chunk_source(path: str, source: str) -> list[Span]:
    suffix = PurePath(path).suffix.lower()
    spans = py_spans(source) if suffix in L.PY_EXTENSIONS else js_spans(source) if suffix in L.JS_EXTENSIONS else []
    return spans or window_spans(source)


def _chunk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for seq, path, source in zip(part["seq"], part["path"], part["content"]):
            lines = source.split("\n")
            for i, (a, b, name) in enumerate(chunk_source(path, source)):
                rows.append((path, seq, i, f"{path}:{a + 1}-{b + 1}", a + 1, b + 1, name, "\n".join(lines[a : b + 1])))
        yield pd.DataFrame(rows, columns=["path", "seq", "ord", "id", "start", "end", "name", "text"])


def chunk_files(files: DataFrame) -> DataFrame:
    """(seq, path, content) to snippets; a null content has none."""
    return files.where("content IS NOT NULL").select("seq", "path", "content").mapInPandas(_chunk, SNIPPET)


def line_windows(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, start, end, name, text) overlapping windows of lines, without blank ones; no Python."""
    step = max(size - overlap, 1)
    lines = df.select(F.col(id_col), F.split(F.col(text_col), "\n", -1).alias("_l")).withColumn("_n", F.size("_l"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / F.lit(step)).cast("int")) * step
    cut = lines.where("_n > 0").select(id_col, "_l", "_n", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("_i"))
    cut = cut.select(id_col, (F.col("_i") + 1).alias("start"), F.least(F.col("_i") + size, F.col("_n")).alias("end"), F.array_join(F.slice("_l", F.col("_i") + 1, F.lit(size)), "\n").alias("text"))
    return cut.where(strip("text") != "").withColumn("name", F.format_string("lines %d-%d", "start", "end"))


def stable_ids(snippets: DataFrame, path: str = "path", name: str = "name", order: list[str] | None = None) -> DataFrame:
    """Adds ``sid``: path::name, and #2, #3, ... for later ones of the same name."""
    n = F.row_number().over(W.partitionBy(path, name).orderBy(*(order or ["seq", "ord"])))
    base = F.concat_ws("::", path, name)
    return snippets.withColumn("_n", n).withColumn("sid", F.when(F.col("_n") > 1, F.concat(base, F.lit("#"), F.col("_n").cast("string"))).otherwise(base)).drop("_n")
