"""Command line: ``python -m lodestone l|x|c|r|s|i|formats|plugins|version``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import formats
from .operators import carve, identify, recover, write
from .sources import registry


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("verb", choices=["l", "x", "c", "r", "s", "i", "formats", "plugins", "version"])
    p.add_argument("paths", nargs="*")
    p.add_argument("-o", "--output", default=".")
    p.add_argument("-p", "--password")
    p.add_argument("-l", "--level", type=int)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if a.verb == "version":
        print(__version__)
        return 0
    if a.verb not in ("formats", "plugins") and not a.paths:
        p.print_usage(sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.verb == "formats":
        formats.formats(spark).show(100, False)
        return 0
    if a.verb == "plugins":
        registry.BUILT_IN.table(spark).show(100, False)
        return 0
    files = spark.read.format("binaryFile").load(a.paths if a.verb != "c" else a.paths[1:])
    if a.verb == "c":
        rows = files.select(F.lit("out").alias("archive"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        kind = write.writer_for(a.paths[0])
        if kind in write.WRITERS:
            data = write.pack(rows, "archive", "name", "content", kind=kind, level=a.level).first()["content"]
        else:
            data = write.compressed(rows, kind, level=a.level).first()["packed"]
        with open(a.paths[0], "wb") as f:
            f.write(bytes(data))
        return 0
    if a.verb == "i":
        identify.identify(files).show(1000, False)
        return 0
    if a.verb == "s":
        carve.carve(files).show(1000, False)
        return 0
    if a.verb == "r":
        recover.summary(recover.recover(files)).show(1000, False)
        return 0
    entries = registry.read_entries(registry.join_volumes(files), want_content=a.verb == "x", password=a.password)
    if a.verb == "x":
        out = write.extract_to(entries, a.output)
        bad = out.where("error is not null").count()
        return 2 if bad or entries.where("error is not null").count() else 0
    entries.select("archive_path", "name", "uncompressed_size", "modified", "method", "is_encrypted", "error").show(100_000, False)
    return 2 if entries.where("error is not null").count() else 0


if __name__ == "__main__":
    sys.exit(main())
