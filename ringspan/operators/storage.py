"""Where loops keep their state: the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and everything runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.startswith("local-") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/ringspan-{os.getpid()}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def at(df: DataFrame, path: str) -> DataFrame:
    """Notes where a table of our own lies, for :func:`discard`."""
    df._ringspan_path = path
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which survives lost executors."""
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)
    return at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of :func:`written` once all that reads them has been written itself. Others are left alone."""
    for df in tables:
        if path := getattr(df, "_ringspan_path", None):
            file = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(file, True)
