"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application, once: workers import it even where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom_package.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
