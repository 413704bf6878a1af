"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCRATCH: list[str] = []


def local_session(cores: str = "*", name: str = "querymill") -> SparkSession:
    """Session for tests and benches on one machine, with a folder of its own to stage tables in."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        # small test data: keep all cores busy instead of packing one megabyte per task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_KEY, os.environ.get("QUERYMILL_SCRATCH") or tempfile.mkdtemp(prefix="querymill-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else a folder of the warehouse, which is shared too."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, gone after the next discard_scratch()."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


def discard_scratch(spark: SparkSession) -> None:
    """Delete what runs of this process have staged. Call it when their results have been written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(hadoop).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later rounds neither recompute it nor depend on one executor.

    One job; a checkpoint would compute the table twice, once to count and once to write it. The job's shuffle files go with it;
    they would else stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    kept = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, kept)
    return spark.read.schema(df.schema).parquet(path)
