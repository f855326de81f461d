"""Python code of this package inside tasks."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for a session's context: they need not have
    it installed."""
    context = spark.sparkContext
    if not getattr(context, "_matchlens_shipped", False):
        package = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp()}/{package.name}-{uuid.uuid4().hex}"
        archive = shutil.make_archive(name, "zip", package.parent, package.name)
        context.addPyFile(archive)
        context._matchlens_shipped = True
