"""A session with the settings that the library's plans expect."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes with the last frame that reads it
}


def session(app: str = "strataledger", master: str | None = None, **settings: str) -> SparkSession:
    """A session; keyword settings have underscores for dots. Partition counts are left to the cluster and to AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a temporary one only where Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df's rows, written once as Parquet to a shared folder and read from there, which goes when the block ends.

    Shuffles of the write are dropped as soon as it is done: else they stay until the driver happens to collect its garbage.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, path = spark.conf.get(cleanup, None), shared_folder(spark, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        spark.conf.set(cleanup, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
