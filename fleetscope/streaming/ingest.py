"""Launch files as a stream: files that arrive in a folder are parsed once, and their rows and issues kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetscope.sources.launch import LaunchModel, format_of, parse_documents


def launch_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """program.SCHEMA rows of the launch files that come into ``path``."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    fmt = format_of(F.lower("path"))
    return parse_documents(raw.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("path"), fmt.alias("format"), "content").where("format IS NOT NULL"))


def keep_issues(rows: DataFrame, out: str, checkpoint: str, timestamp: str | None = None) -> DataStreamWriter:
    """A writer that appends each batch's action rows and structural issues below ``out``; a batch that is run again replaces its own partition."""

    def batch(frame: DataFrame, n: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        kept = frame.sparkSession.read.schema(frame.schema).parquet(f"{out}/rows/batch={n}")
        LaunchModel(kept, True).issues(timestamp=timestamp).write.mode("overwrite").parquet(f"{out}/issues/batch={n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
