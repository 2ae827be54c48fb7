"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder serves only a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = "file://" + tempfile.mkdtemp(prefix="tracelight-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    spark.sparkContext.setCheckpointDir(shared_base(spark))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below it."""
    return f"{shared_base(spark)}/tracelight/{uuid.uuid4().hex}"
