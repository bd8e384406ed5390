"""Makes the package importable in the session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, unless PYTHONPATH already leads them to it.

    Spark's own file server hands the archive to each executor, so no folder
    needs to be shared. A session gets it once.
    """
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(_ROOT.parent) in paths or sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="siltseek-")) / "siltseek_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
