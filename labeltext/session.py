"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    The folder must be one that the driver and all executors share, so there is
    no fallback to a folder of this machine: without the setting this fails. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes what is no
    longer referenced.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder)
    return folder
