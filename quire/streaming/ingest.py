"""Continuous ingestion: new files in a folder become tagged sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources.files import ingest


def watch(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(folder).select("path", "content")


def start(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; each file's sections are appended to ``out`` once."""
    return ingest(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
