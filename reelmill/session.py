"""Makes this package importable in the Python workers of a session, wherever it was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once a session."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        if package.is_dir():  # else it was itself shipped in an archive
            archive = Path(tempfile.mkdtemp(prefix="reelmill-code-")) / "reelmill.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for source in sorted(package.rglob("*.py")):
                    z.write(source, Path(package.name) / source.relative_to(package))
            context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
