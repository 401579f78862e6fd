"""The folder that driver and executors share, for what outlives a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine, and then for checkpoints too, only where none is set and Spark runs locally."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="planmatch-")
    context.setCheckpointDir(folder)
    return folder


def cut(rows: DataFrame) -> DataFrame:
    """``rows``, computed once, written as a table in the shared folder and read again by each use."""
    path = f"{shared_folder(rows.sparkSession)}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
