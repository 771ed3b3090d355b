"""Relational operators over entries, listings and installer tables, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import with_number
from ..shipping import ship

MAX_DEPTH = 64


def last_wins(entries: DataFrame, archive: str = "archive_path", path: str = "safe_path", order: str = "entry_index") -> DataFrame:
    """Of entries with one path, the last in archive order."""
    n = F.row_number().over(Window.partitionBy(archive, path).orderBy(F.desc(order)))
    return entries.withColumn("_n", n).where("_n = 1").drop("_n")


def suffixed(entries: DataFrame, archive: str = "archive_path", path: str = "safe_path", order: str = "entry_index", *, pattern: str = "_%d", ignore_case: bool = False) -> DataFrame:
    """All entries, with ``unique_path``: in archive order an entry keeps its path while that is free, else it gets the
    first number from 2 on, before its extension, that gives a free one. ``order`` numbers an archive's entries.

    Only archives in which a path repeats are looked at whole (names, no content), each in one task as an archive is."""
    key = F.lower(path) if ignore_case else F.col(path)
    repeated = entries.groupBy(archive, key.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select(archive).distinct()
    names = entries.select(archive, order, path).where(F.col(path).isNotNull()).join(repeated, archive, "left_semi")
    fold = str.lower if ignore_case else str

    def free(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        used, tried, out = set(), {}, []
        for name in pdf[path]:
            now, n = name, tried.get(name, 1)
            while fold(now) in used:
                n += 1
                now = with_number(name, pattern % n)
            used.add(fold(now))
            tried[name] = n
            out.append(now)
        return pd.DataFrame({archive: pdf[archive], order: pdf[order], "_free": out})

    ship(entries.sparkSession)
    kinds = entries.select(archive, order).schema
    named = names.groupBy(archive).applyInPandas(free, f"`{archive}` {kinds[archive].dataType.simpleString()}, `{order}` {kinds[order].dataType.simpleString()}, _free string")
    return entries.join(named, [archive, order], "left").withColumn("unique_path", F.coalesce("_free", path)).drop("_free").select(*entries.columns, "unique_path")


def running_limit(entries: DataFrame, size: Column, group: str, order: list, *, max_total: int, archive_size: Column | None = None, max_ratio: int = 0, ratio_threshold: int = 0) -> DataFrame:
    """Running total of a group in order, and whether a limit is exceeded by then (ratios divide as integers)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = entries.withColumn("running_total", F.sum(size).over(w))
    over = F.col("running_total") > max_total if max_total else F.lit(False)
    if archive_size is not None and max_ratio:
        over = over | ((F.col("running_total") > ratio_threshold) & (F.floor(F.col("running_total") / F.greatest(archive_size, F.lit(1))) > max_ratio))
    return out.withColumn("exceeded", over)


def listing_with_files(listing: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Listed entries with the file that was extracted for each, then the files that nobody listed, as ``extra``."""
    listed = listing.join(files, key, "left").withColumn("extra", F.lit(False))
    return listed.unionByName(files.join(listing, key, "left_anti").withColumn("extra", F.lit(True)), allowMissingColumns=True)


def golden_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, as sets, with ``side``."""
    return expected.subtract(actual).withColumn("side", F.lit("expected")).unionByName(actual.subtract(expected).withColumn("side", F.lit("actual")))


def media_of(files: DataFrame, media: DataFrame, package: str = "package", seq: str = "sequence", last: str = "last_sequence", disk: str = "cabinet") -> DataFrame:
    """Each file's cabinet: its package's first media whose last sequence isn't below the file's; null if there is none.

    A package has a media row for each disk; they meet the files as one sorted array by the package's key, so the range
    condition never multiplies rows."""
    table = media.groupBy(package).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(last), F.lit(0)).alias("last"), F.col(disk).alias("disk")))).alias("_media"))
    found = F.filter("_media", lambda m: m["last"] >= F.col(seq))
    return files.join(table, package, "left").withColumn(disk, F.get(found, F.lit(0))["disk"]).drop("_media")


def directory_paths(directories: DataFrame, package: str = "package", key: str = "directory", parent: str = "parent", name: str = "name", depth: int = MAX_DEPTH) -> DataFrame:
    """Full path of every directory: parents are joined level by level until no row is open; a loop ends at ``depth``."""
    base = directories.select(package, F.col(key).alias("_key"), F.col(parent).alias("_parent"), F.col(name).alias("_name"))
    level = base.where("_parent is null or _parent = _key").select(package, "_key", F.col("_name").alias("path"))
    out = level
    for _ in range(depth):
        above = level.select(package, F.col("_key").alias("_parent"), "path")
        level = base.where("_parent <> _key").join(above, [package, "_parent"]).select(package, "_key", F.concat("path", F.lit("/"), "_name").alias("path"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.withColumnRenamed("_key", key)


def installed_files(file: DataFrame, component: DataFrame, directories: DataFrame, media: DataFrame, package: str = "package") -> DataFrame:
    """The file trees of installers: file ⋈ component ⋈ directory path, with cabinets.

    All tables have a package column; file(file, component, name, size, sequence), component(component, directory),
    directories(directory, parent, name), media(last_sequence, cabinet)."""
    paths = directory_paths(directories, package)
    out = file.join(component, [package, "component"]).join(paths, [package, "directory"], "left")
    out = out.withColumn("install_path", F.concat_ws("/", "path", F.substring_index("name", "|", -1)))
    return media_of(out, media, package).select(package, "file", "install_path", "size", "sequence", "cabinet")


def best_overlap(keys: DataFrame, candidates: DataFrame, key: str, group: str) -> DataFrame:
    """The group that holds most of the expected keys."""
    n = candidates.join(keys, key, "left_semi").groupBy(group).agg(F.count("*").alias("n"))
    return n.agg(F.max_by(group, F.struct("n", group)).alias(group), F.max("n").alias("n"))


def not_before(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Files that are there now and weren't before."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def columns_of(schema: DataFrame, table: str, number: str, column: str) -> DataFrame:
    """Columns of each table in order."""
    return schema.groupBy(table).agg(F.transform(F.array_sort(F.collect_list(F.struct(number, column))), lambda s: s[column]).alias("columns"))


def gaps(pieces: DataFrame) -> DataFrame:
    """Places where pieces don't tile their file: the distance between a piece's start and the end before it."""
    before = F.lag(F.col("offset") + F.col("length"), 1, 0).over(Window.partitionBy("archive_path").orderBy("offset"))
    return pieces.withColumn("gap", F.col("offset") - before).where("gap <> 0")


def after_damage(entries: DataFrame, block: str, order: str, failed: Column) -> DataFrame:
    """Entries of a solid block, ``lost`` where an earlier one of the block failed."""
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("lost", F.coalesce(F.max(failed).over(w), F.lit(False)))
