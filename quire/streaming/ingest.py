"""Continuous ingest: new book files in a folder become chapter rows.

An extension; nothing in the batch operators depends on it. Exactly-once
through the checkpoint and the file sink's log.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.html import html_to_text
from ..sources.containers import chapter_files, file_glob


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, kind: str = "epub", *, once: bool = True) -> StreamingQuery:
    """Read what has come into ``folder`` and append chapter files with their text to Parquet under ``target``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", file_glob(kind)).option("maxFilesPerTrigger", 1000).load(folder)
    rows = chapter_files(files, kind).withColumn("content", html_to_text(F.col("html")))
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
