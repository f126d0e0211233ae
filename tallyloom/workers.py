"""Hands this package to Python workers, so that functions in it need not be installed on every machine."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    file = f"{tempfile.mkdtemp(prefix='package-')}/{top.name}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(file)
    context._tallyloom_shipped = True
