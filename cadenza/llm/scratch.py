"""Intermediate tables that survive the loss of an executor.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session.

    On a local master, where driver and executors are one process, an unset
    folder is created; on a cluster an unset folder is an error.
    """
    folder = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cadenza-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of that table."""
    return read_back(df.sparkSession, store(df, tag), df)


def store(df: DataFrame, tag: str) -> str:
    path = f"{application_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def read_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application; call it once results are written."""
    remove(spark, application_folder(spark))


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package shipped to the executors, whose modules keep their caches between tasks.

    A worker lives on after its task; what the task has freed goes back to the system.
    """
    ship(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library, where it can, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
