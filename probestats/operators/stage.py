"""Written intermediate tables, so that a long chain is not recomputed by each of its readers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    There is no local stand-in: on a cluster each executor would write its part to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return folder


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/probestats/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. This runs a job.

    Unlike a cached copy it outlives its executors, and later scans prune its columns.
    """
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_driver(spark: SparkSession) -> None:
    """Collects the driver's garbage, so that Spark drops the shuffles and broadcasts of plans that are done.

    Spark finds them only when the driver's JVM collects its garbage, and a heap with room seldom does: in a long chain
    of plans it would grow to its limit first, and its threads and native memory with it.
    """
    gc.collect()  # Python's DataFrames hold their plans in the JVM
    spark.sparkContext._jvm.System.gc()


def drop_stages(spark: SparkSession) -> None:
    """Remove all stages this application wrote; DataFrames that read them are of no use afterwards."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
