"""Tables between jobs, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir. A local master, one process, makes one where none is set; on a cluster that is an error."""
    setting = "spark.checkpoint.dir"
    folder = spark.sparkContext.getConf().get(setting) or spark.conf.get(setting, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{setting} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set(setting, folder)
    return f"{folder.rstrip('/')}/cadenza-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The table, written and read again: its lineage ends there, and a lost executor costs what reads it only."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
