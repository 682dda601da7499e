"""Durable intermediate data.

Lineage is cut only through files every executor can reach: the folder the cluster names in
``spark.checkpoint.dir``. Without that setting a single-process ``local`` session gets one temporary root of its
own, since driver and tasks are then the same machine; any other master is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates; one per session."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    in_process = re.fullmatch(r"local(\[.*\])?", context.master) is not None
    if not configured:
        if not in_process:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mealgrid-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in reliable storage and return it with a cut lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder name below the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cut lineage, known sizes, only needed columns read.

    The files belong to the session's shared folder and go with it; a lazily used result may still need them.
    """
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
