"""Making the package importable in Python workers that do not see the driver's files."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Hands the package to the session's executors, once per application; nothing where they inherit its path."""
    sc = spark.sparkContext
    if getattr(sc, "_stipple_shipped", False):
        return
    sc._stipple_shipped = True
    inherited = sc.master.startswith("local") and str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if inherited:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="stipple-package-"), "stipple.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, str(f.relative_to(ROOT.parent)))
    sc.addPyFile(target)
