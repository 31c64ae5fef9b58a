"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="casegraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, owner: str = "query") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The table goes when its owner is released, or with the application.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/casegraph-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _owned.setdefault(owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    for _ in range(2):  # what Python has let go reaches the JVM with the first call
        spark._jvm.System.gc()
        time.sleep(0.3)


def release(spark: SparkSession, owner: str = "query") -> None:
    """Delete the tables that ``owner`` has written, once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in _owned.pop(owner, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
