"""The folder for intermediate tables that all executors share."""

import tempfile
import uuid

from pyspark.sql import SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """As the session names it; where it names none, a local one of this session, which only
    executors inside the driver can see."""
    folder = spark.conf.get(FOLDER, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"{FOLDER} must name a folder that the driver and all executors share")
    if not hasattr(context, "_matchlens_folder"):
        context._matchlens_folder = "file://" + tempfile.mkdtemp(prefix="matchlens-")
    return context._matchlens_folder


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
