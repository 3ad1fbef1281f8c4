"""Makes this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once per application, so that tasks can import them wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="siltstone-ship-")) / "siltstone_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
