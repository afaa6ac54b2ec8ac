"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application, unless PYTHONPATH has them already."""
    sc = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_maskspark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="maskspark-")) / "maskspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in ROOT.rglob("*.py"):
            z.write(path, path.relative_to(ROOT.parent))
    sc.addPyFile(str(archive))
    sc._maskspark_shipped = True
