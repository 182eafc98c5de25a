"""Where jobs cut lineage: the folder that the cluster names in ``spark.checkpoint.dir``.

Only where that setting is unset and the session is local (tests, a laptop) a folder of our own is used. Tables lie in one
folder per application, which ``sweep`` deletes; operators ``discard`` those that nothing will read again.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where a local session names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/playtrace"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; sets the checkpoint directory if none is set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = named or LOCAL_FOLDER
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


#: Has Spark delete the shuffle files of a query as soon as it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd", tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Use it where several later jobs read the same computed rows. Each call has a folder of its own. With ``tidy`` the
    shuffle files of the write go with its end, not when the driver's JVM happens to collect its plan.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no frame in use reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still read them must be stored first."""
    _delete(spark, _tables(spark))


def release(spark: SparkSession) -> None:
    """Ask Spark's cleaner to delete the shuffle files of finished jobs that nothing refers to any more.

    Left alone, the driver's JVM may collect the finished plans long after a chain of large jobs. Results don't depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
