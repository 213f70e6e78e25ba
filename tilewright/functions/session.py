"""What operators need of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """``spark`` with a checkpoint folder: that of ``spark.checkpoint.dir``, or a temporary one where none is set."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='tilewright-')}")
    return spark


def reachable(spark: SparkSession, folder: str) -> SparkSession:
    """``spark`` with ``folder`` on the module path of Python workers on this machine."""
    paths = spark.sparkContext.environment
    known = paths.get("PYTHONPATH", "")
    if folder not in known.split(":"):
        paths["PYTHONPATH"] = f"{folder}:{known}" if known else folder
    return spark
