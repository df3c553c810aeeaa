"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Set here only on a local master where both are unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="fleetscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below root(); it is deleted when the driver's JVM ends, as a result may be read until then."""
    made = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return made


#: Tasks a core that spread() makes, so that cores which end early take more.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores, for rows that are small to read and slow to work on: however few files or row groups hold them."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back: its plan starts there, and lost executors cost nothing that came before."""
    path = f"{folder(df.sparkSession, name)}/0"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
