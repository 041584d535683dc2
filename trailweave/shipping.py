"""Brings this package to the executors' Python workers, once a session."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, so that workers can import them wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = Path(importlib.util.find_spec("trailweave").origin).parent
    target = os.path.join(tempfile.mkdtemp(prefix="trailweave-"), "trailweave_sources.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
