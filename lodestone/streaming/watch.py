"""A folder of archives as a stream of entries: new files are read once, as Structured Streaming's file source does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.registry import read_entries

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, *, max_files: int = 16, **kw) -> DataFrame:
    """Entries of archives as they arrive in ``folder``; at most ``max_files`` archives a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(folder)
    return read_entries(files.select("path", "content"), **kw)
