"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a write go when it is done; nothing reads them after that.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset, a folder of this process on a local master, as in tests; elsewhere the executors could not see that, so that it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="clusterlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up then
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    This cuts the lineage, survives lost executors, and lets two consumers share one computation. Removed by released(), or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables that written() made and nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            remove(t.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows and bytes of an Arrow batch at most, from here on in the session: rows that hold texts or groups of rows can be far larger than usual."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
