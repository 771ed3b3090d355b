"""What the operators share: columns in and out, samples of bounded size, shared folders, hashed linear models."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow

#: Broadcasts and driver-side tables are only made below this many bytes.
BROADCAST_LIMIT = 64 << 20
#: Features of sampled rows that fitting takes to the driver (expected).
FEATURE_BYTES = 192 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir. Where that is unset, a temporary folder serves
    a session whose tasks run in the driver's own process; any other is refused, as its executors share no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder. The files stay until the application's folder is cleared, or, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, until nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the commands in the block go when a command ends, not when the driver's JVM collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class Scratch:
    """Parquet tables that an operator makes on its way, in the shared folder: each is written once, read with column
    pruning by as few tasks as its size needs, and dropped by name; what is left goes at the end of a ``with`` block."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self._made = spark, 0
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._made}"
        self._made += 1
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                self._delete(t._scratch)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.base)


def id_text(col) -> object:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def labelled_sample(labels: DataFrame, key: str, label: str, max_rows: int, keep=None) -> DataFrame:
    """At most about ``max_rows`` labelled rows (id, y): all rows whose id hash falls below a share of the hash range.

    The share follows from the number of rows, so the expected size is ``max_rows`` at any input size. Rows with a null
    id or label are left out, repeated rows count once.
    """
    t = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    if keep is not None:
        t = t.where(keep(F.col("_id")))
    t = t.distinct()
    n = t.count()
    if n > max_rows:
        t = t.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_rows / n)))
    return t


def sparse_rows(sample: DataFrame, docs: DataFrame, key: str, text: str, features, extra=(), max_bytes: int = FEATURE_BYTES) -> pa.Table:
    """Hashed features of the sampled documents, made on the executors: a row (_id, _y, idx, val) for each.

    Only ``max_bytes`` of features (expected) reach the driver: the features stay in the shared folder until their sum is
    known, and where it is larger, the share of rows that fits is taken by a hash of the id and the features. Repeated rows of an id count
    once if their features are equal."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), *extra).join(F.broadcast(sample), "_id")

    def run(batches):
        from . import textkernel as tk

        for batch in batches:
            for part in tk.slices(batch, "_text", 1 << 19):
                idx, val, at = features(part.column(part.schema.get_field_index("_text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("_id")).cast(pa.string()), part.column(part.schema.get_field_index("_y")).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(idx, pa.int32())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(val, pa.float32()))],
                    names=["_id", "_y", "idx", "val"],
                )

    with Scratch(docs.sparkSession, "features") as scratch:
        made = scratch.keep(map_arrow(rows, run, "_id string, _y int, idx array<int>, val array<float>").withColumn("_h", F.xxhash64("idx", "val")).dropDuplicates(["_id", "_y", "_h"]))
        size = made.agg(F.sum(8 * F.size("idx") + 16)).first()[0] or 0
        if size > max_bytes:
            made = made.where(F.pmod(F.xxhash64("_id", "_h"), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_bytes / size)))
        out = made.toArrow()
    return out.sort_by([("_id", "ascending"), ("_y", "ascending"), ("_h", "ascending")])


def csr(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row offsets, indexes and values of ``sparse_rows``."""
    idx, val = table["idx"].combine_chunks(), table["val"].combine_chunks()
    at = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(idx)), dtype=np.int64)))
    return np.asarray(table["_y"], np.float64), at, np.asarray(idx.flatten()), np.asarray(val.flatten(), np.float32)


def unique_per_row(idx: np.ndarray, row: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, index) pairs in order, how often each stands, and row offsets."""
    key = (row.astype(np.int64) << bits) | idx.astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits)
    return (key & ((1 << bits) - 1)).astype(np.int32), counts.astype(np.float32), at.astype(np.int32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic calibration of scores (Newton steps, targets smoothed by the class counts)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if pos == 0 or neg == 0:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(w * score * score) + 1e-6, np.sum(w * score)], [np.sum(w * score), np.sum(w) + 1e-6]])
        d = np.linalg.solve(h, np.array([np.sum(g * score), np.sum(g)]))
        d *= min(1.0, 5 / max(1e-9, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)
