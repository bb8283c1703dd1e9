"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name in the folder that spark.checkpoint.dir names; what is written there goes when the driver ends. Only a
    local master (tests), where there is one machine, may go without that setting."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not known.isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lemmaflow-"))
        shared = context._jsc.sc().getCheckpointDir().get()
    path = f"{shared.rstrip('/')}/lemmaflow-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: a loop's plan stays small, and a lost executor costs no more than its own tasks."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
