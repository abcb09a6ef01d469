"""Sending the package to executors that run on other machines."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once; in local mode workers import what the driver imports."""
    sc = spark.sparkContext
    local = sc.master == "local" or sc.master.startswith("local[")
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if local and str(PACKAGE.parent) in map(str, map(Path.resolve, map(Path, _python_path(sc)))):
        return
    made = tempfile.mkdtemp(prefix="tapeloom-")  # executors fetch the file from the driver as long as it runs
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/tapeloom.zip", "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(f"{made}/tapeloom.zip")


def _python_path(sc) -> list[str]:
    """Where local workers look: the working folder and PYTHONPATH."""
    import os

    return [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
