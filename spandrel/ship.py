"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context. Functions of the package then unpickle there by
    name, whatever the workers' folder or path."""
    context = spark.sparkContext
    if getattr(context, "_spandrel_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # already inside an archive that was sent
        return
    archive = Path(tempfile.mkdtemp(prefix="spandrel-")) / "spandrel.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spandrel_shipped = True
