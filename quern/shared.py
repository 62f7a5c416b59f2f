"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths written by this process, for those who want to delete them.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder in local mode, and an error elsewhere: executors could not read what others write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        found = _LOCAL[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lost executors recompute nothing before this point."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def release(spark: SparkSession) -> None:
    """Let go of plans that are done: what their shuffles left on the executors' disks goes once nothing refers to it."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete all tables of this process; results that still read them fail afterwards."""
    delete(spark, list(WRITTEN))
