"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lodestone", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)


def release() -> None:
    """Give freed memory back to the system: a worker that idles between tasks should hold little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker keeps from task to task, by name.
_kept: dict[str, object] = {}


def keep(name: str, make):
    """An object that a Python worker keeps for the tasks that ask for it by name."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def keep_only(name: str | None) -> None:
    """Drop what earlier tasks of other kinds kept."""
    for other in [k for k in _kept if k != name]:
        del _kept[other]


def map_arrow(df: DataFrame, function, schema, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` whose function may import this package, and whose workers are tidied up after each task. What a
    worker kept by another name than ``keeps`` is dropped first."""
    ship(df.sparkSession)

    def run(batches):
        from lodestone.shipping import keep_only, release

        keep_only(keeps)
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)
