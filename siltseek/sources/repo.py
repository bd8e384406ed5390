"""Source files of a repository as a DataFrame.

Spark's file sources skip names that begin with ``_``, so paths are listed on
the driver and the files read by tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltseek.functions.lexicon import JS_EXTENSIONS, PY_EXTENSIONS, SKIPPED_PARTS


def list_files(root: str | Path, extensions: list[str] | None = None) -> list[str]:
    """Relative paths below ``root`` in path order; extensions in any case."""
    wanted = set(extensions or JS_EXTENSIONS + PY_EXTENSIONS)
    root, found = Path(root), []
    for folder, _, names in os.walk(root):
        for name in names:
            path = Path(folder, name)
            if path.suffix.lower() in wanted and not set(SKIPPED_PARTS) & set(path.parts) and path.is_file():
                found.append(path.relative_to(root))
    return [str(p) for p in sorted(found)]


def _read(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = []
            for path in part["path"]:
                try:
                    texts.append(Path(root, path).read_text(encoding="utf-8"))  # CRLF and CR become LF
                except (UnicodeDecodeError, OSError):
                    texts.append(None)
            yield part.assign(content=texts).dropna(subset=["content"])

    return run


def read_repo(spark: SparkSession, root: str | Path, extensions: list[str] | None = None) -> DataFrame:
    """(seq, path, content) of the readable source files below ``root``."""
    paths = list(enumerate(list_files(root, extensions)))
    parts = max(1, min(len(paths), 64))
    listed = spark.createDataFrame(paths, "seq long, path string").repartition(parts)
    return listed.mapInPandas(_read(str(root)), "seq long, path string, content string")
