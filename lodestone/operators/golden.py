"""Listings and contents as sorted text lines, the form in which results are kept for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import safe_path


def _joined(rows: DataFrame, line: Column, head: Column, name: str) -> DataFrame:
    """One text per archive: a heading and its lines, sorted. An archive's lines are its own size, like its entries."""
    out = rows.groupBy("archive_path").agg(F.count(line).alias("n"), F.sort_array(F.collect_list(line)).alias("lines"), F.first("error", ignorenulls=True).alias("error"))
    failed = F.col("error").isNotNull() & (F.col("n") == 0)
    step = F.lit(f"{name}: ERROR ")
    return out.select("archive_path", F.when(failed, F.concat(step, F.col("error.class"), F.lit(": "), F.col("error.message"))).otherwise(F.array_join(F.concat(F.array(head), F.col("lines")), "\n")).alias(name))


def listing(entries: DataFrame) -> DataFrame:
    """archive_path and ``list``: the number of entries, then ``name size [encrypted]`` or ``name (folder)`` lines;
    a size that isn't known is -1."""
    size = F.coalesce("uncompressed_size", F.lit(-1)).cast("string")
    file = F.concat(F.lit("  "), F.col("name"), F.lit(" "), size, F.when(F.col("is_encrypted"), " [encrypted]").otherwise(""))
    line = F.when(F.col("name").isNotNull(), F.when(F.col("is_directory"), F.concat(F.lit("  "), F.col("name"), F.lit(" (folder)"))).otherwise(file))
    return _joined(entries, line, F.concat(F.lit("list: "), F.col("n").cast("string"), F.lit(" entries")), "list")


def contents(entries: DataFrame) -> DataFrame:
    """archive_path and ``extracted``: the number of files, then ``path size sha256`` lines."""
    line = F.when(F.col("content").isNotNull(), F.concat(F.lit("  "), safe_path(F.col("name")), F.lit(" "), F.octet_length("content").cast("string"), F.lit(" "), F.col("sha256")))
    return _joined(entries, line, F.concat(F.lit("extracted: "), F.col("n").cast("string"), F.lit(" items")), "extracted")


def report(recovered: DataFrame) -> DataFrame:
    """archive_path and ``report``: a line for each file, in order, with its status, bytes, expected size and message."""
    line = F.format_string("%-12s %s (%d of %s bytes)%s", "status", F.coalesce("name", F.lit("?")), "bytes_written", F.coalesce(F.col("expected_size").cast("string"), F.lit("?")), F.coalesce(F.concat(F.lit(": "), F.col("message")), F.lit("")))
    rows = recovered.groupBy("archive_path").agg(F.array_sort(F.collect_list(F.struct("entry_index", line.alias("line")))).alias("lines"))
    return rows.select("archive_path", F.array_join("lines.line", "\n").alias("report"))
