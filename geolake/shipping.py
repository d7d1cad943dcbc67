"""This package's modules for the executors, where Python functions over Arrow columns run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the modules to the executors, once for each application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="geolake-")) / "geolake_package.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(out))
