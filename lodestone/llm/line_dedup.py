"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at its ends, A-Z lower-cased, as a 128-bit hash. The index has

* ``postings`` (shard, hi, lo, id): each long enough key of each document, once;
* ``refs`` (shard, hi, lo, n_docs, keeper): exact number of documents of a key and the largest id holding it;
* ``filters`` (shard, filter): a cuckoo filter of the shard's shared keys, those found in at least ``min_docs``
  documents. Shards are ranges of the hash, so many that a filter has some ten thousand keys at any input size.

A shard's filter has room for ``shard_keys`` keys; an index that outgrows this gets more shards from the exact table.

``insert`` and ``delete`` take documents in and out: reference counts change by the documents' own postings, and keys
that cross the threshold are put into, or removed from, their shard's filter, so deleting what was inserted restores
the index. Applying the index probes the filters first (broadcast while they are small, which is checked; beyond that
the probe is left out) and then joins the reference counts exactly, so a filter's false positives never drop a line.

A key held by a third of all documents is counted with partial aggregation and joined with its one reference row; no
key's documents are ever gathered.

Defined results: a null or empty text is one empty line; a key counts a document id once, however often rows repeat
it; rows with a null id are not counted and keep all lines; an empty table gives an empty result; all columns of the
documents are kept, columns added have names of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from . import common

MIN_DOCS = 5
MIN_CHARS = 40
SHARD_KEYS = 1 << 15
_WHITE = " \t\n\x0b\x0c\r"
_KEY = "hi long, lo long"


def keys(lines: list[str], min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """16-byte keys of lines; None where a key is too short."""
    digest = xxhash.xxh3_128_digest
    # bytes.lower() changes A-Z only
    return [digest(k.encode("utf-8", "surrogatepass").lower()) if len(k := line.strip(_WHITE)) >= min_chars else None for line in lines]


class Cuckoo:
    """A cuckoo filter over 64-bit hashes: buckets of four 16-bit fingerprints, two buckets for each key."""

    def __init__(self, slots: np.ndarray, stash: list[int] = ()):
        self.slots, self.stash = slots, set(map(int, stash))

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((max(2, 1 << math.ceil(math.log2(max(1, n / 3.4)))), 4), np.uint16))

    @staticmethod
    def _spread(x):
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

    def _places(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            mask = np.uint64(len(self.slots) - 1)
            fp = (h >> np.uint64(48)) | np.uint64(1)
            one = h & mask
            return fp, one, one ^ (self._spread(fp) & mask)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(h)
        f = fp.astype(np.uint16)[:, None]
        out = (self.slots[one.astype(np.int64)] == f).any(1) | (self.slots[two.astype(np.int64)] == f).any(1)
        return out | np.isin(h, np.array(sorted(self.stash), np.uint64)) if self.stash else out

    def insert(self, h: np.ndarray) -> None:
        fp, one, two = (x.astype(np.int64) for x in self._places(h))
        mask = len(self.slots) - 1
        for f, a, b, whole in zip(fp.tolist(), one.tolist(), two.tolist(), h.tolist()):
            for at in (a, b):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = f
                    break
            else:
                trail, at = [], b
                for turn in range(200):
                    k = (turn * 7 + f) & 3
                    trail.append((at, k, int(self.slots[at, k])))
                    f, self.slots[at, k] = int(self.slots[at, k]), f
                    at = (at ^ ((f * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32)) & mask
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = f
                        break
                else:  # too full: undo, and remember the whole hash
                    for at, k, was in reversed(trail):
                        self.slots[at, k] = was
                    self.stash.add(whole)

    def delete(self, h: np.ndarray) -> None:
        """Remove keys that were inserted."""
        fp, one, two = (x.astype(np.int64) for x in self._places(h))
        for f, a, b, whole in zip(fp.tolist(), one.tolist(), two.tolist(), h.tolist()):
            if whole in self.stash:
                self.stash.remove(whole)
                continue
            for at in (a, b):
                found = np.flatnonzero(self.slots[at] == f)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def dump(self) -> bytes:
        return len(self.slots).to_bytes(8, "little") + self.slots.tobytes() + np.array(sorted(self.stash), np.uint64).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        n = int.from_bytes(raw[:8], "little")
        return cls(np.frombuffer(raw, np.uint16, n * 4, 8).reshape(n, 4).copy(), np.frombuffer(raw, np.uint64, offset=8 + n * 8).tolist())


def _postings(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            at, got = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text and len(text) >= min_chars:
                    own = set(keys(text.split("\n"), min_chars))
                    own.discard(None)
                    got += own
                    at += [i] * len(own)
            k = np.frombuffer(b"".join(got), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), batch.column(0).take(pa.array(at, pa.int64()))], names=["hi", "lo", "id"])

    return map_arrow(rows, run, f"{_KEY}, id {rows.schema['id'].dataType.simpleString()}").distinct()


def _shard(n_shards: int):
    return F.pmod(F.col("hi"), F.lit(n_shards)).cast("int")


class LineIndex:
    """See the module. Instances are values: ``insert`` and ``delete`` return another index."""

    def __init__(self, postings: DataFrame, refs: DataFrame, filters: DataFrame, n_shards: int, min_docs: int, min_chars: int, shard_keys: int, n_keys: int):
        self.postings, self.refs, self.filters = postings, refs, filters
        self.n_shards, self.min_docs, self.min_chars, self.shard_keys, self.n_keys = n_shards, min_docs, min_chars, shard_keys, n_keys

    @classmethod
    def build(cls, docs: DataFrame, *, id_col="doc_id", text_col="text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        postings = common.checkpointed(_postings(docs, id_col, text_col, min_chars))
        return cls._of(postings, postings.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")), min_docs, min_chars, shard_keys)

    @classmethod
    def _of(cls, postings: DataFrame, refs: DataFrame, min_docs: int, min_chars: int, shard_keys: int) -> LineIndex:
        shared = common.checkpointed(refs.where(F.col("n_docs") >= min_docs))
        n_keys = shared.count()
        n_shards = 1 << max(0, math.ceil(math.log2(max(1, n_keys) / shard_keys)))
        ship(postings.sparkSession)
        filters = common.checkpointed(shared.select(_shard(n_shards).alias("shard"), "hi").groupBy("shard").applyInArrow(lambda k, t: _new_filter(k, t, shard_keys), "shard int, filter binary"))
        out = cls(postings, refs, filters, n_shards, min_docs, min_chars, shard_keys, n_keys)
        out._shared = shared
        return out

    def shared(self) -> DataFrame:
        """Reference rows of the keys found in enough documents."""
        return getattr(self, "_shared", None) or self.refs.where(F.col("n_docs") >= self.min_docs)

    def _changed(self, postings: DataFrame, refs: DataFrame) -> LineIndex:
        """The index with new tables; filters change by the keys that crossed the threshold."""
        old = self.shared().select("hi", "lo", F.lit(-1).alias("way"))
        new = refs.where(F.col("n_docs") >= self.min_docs).select("hi", "lo", F.lit(1).alias("way"))
        moves = old.unionByName(new).groupBy("hi", "lo").agg(F.sum("way").alias("way")).where("way <> 0").select(_shard(self.n_shards).alias("shard"), "hi", "way")
        ship(postings.sparkSession)
        moves = common.checkpointed(moves)
        held = self.n_keys + (moves.agg(F.sum("way")).first()[0] or 0)
        if held > self.shard_keys * self.n_shards:  # grown beyond its room: more shards, made from the exact table
            return LineIndex._of(postings, refs, self.min_docs, self.min_chars, self.shard_keys)
        room = self.shard_keys
        filters = self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(lambda k, a, b: _moved_filter(k, a, b, room), "shard int, filter binary")
        return LineIndex(postings, refs, common.checkpointed(filters), self.n_shards, self.min_docs, self.min_chars, self.shard_keys, held)

    def insert(self, docs: DataFrame, *, id_col="doc_id", text_col="text") -> LineIndex:
        """The index with more documents (lines of an id that it has already are added to that document)."""
        new = _postings(docs, id_col, text_col, self.min_chars).join(self.postings, ["hi", "lo", "id"], "left_anti")
        new = common.checkpointed(new)
        more = new.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        refs = self.refs.unionByName(more).groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._changed(self.postings.unionByName(new), common.checkpointed(refs))

    def delete(self, ids: DataFrame, *, id_col="doc_id") -> LineIndex:
        """The index without the documents of the given ids."""
        gone = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
        lost = self.postings.join(gone, "id", "left_semi").groupBy("hi", "lo").agg(F.count("*").alias("minus"))
        rest = common.checkpointed(self.postings.join(gone, "id", "left_anti"))
        # only keys that lost a document need another keeper
        touched = rest.join(lost, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("id").alias("now"))
        refs = (
            self.refs.join(lost, ["hi", "lo"], "left").join(touched, ["hi", "lo"], "left")
            .select("hi", "lo", (F.col("n_docs") - F.coalesce("minus", F.lit(0))).alias("n_docs"), F.when(F.col("minus").isNull(), F.col("keeper")).otherwise(F.col("now")).alias("keeper"))
            .where("n_docs > 0")
        )
        return self._changed(rest, common.checkpointed(refs))

    def candidates(self) -> DataFrame:
        """Postings whose key the filters may hold."""
        spark = self.postings.sparkSession
        size = self.filters.agg(F.sum(F.octet_length("filter")).alias("n")).first()["n"] or 0
        if size > common.BROADCAST_LIMIT:
            return self.postings
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
        n_shards = self.n_shards

        def run(batches):
            filters = {k: Cuckoo.load(v) for k, v in shared.value.items()}
            for batch in batches:
                hi = np.asarray(batch.column(0))
                shard, keep = np.mod(hi, n_shards), np.zeros(len(hi), bool)
                for s in np.unique(shard):
                    if s in filters:
                        own = np.flatnonzero(shard == s)
                        keep[own] = filters[s].contains(_filter_hash(hi[own]))
                yield batch.filter(pa.array(keep))

        return map_arrow(self.postings.select("hi", "lo", "id"), run, self.postings.select("hi", "lo", "id").schema)

    def drops(self) -> DataFrame:
        """For each document that loses lines: ``id`` and ``keys``, the keys it loses."""
        lost = self.candidates().join(self.shared(), ["hi", "lo"]).where("id <> keeper")
        return lost.groupBy("id").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))


def _filter_hash(hi) -> np.ndarray:
    from . import textkernel as tk

    return tk.mix(np.asarray(hi, np.int64).view(np.uint64).copy())


def _new_filter(key, table, room: int):
    h = _filter_hash(table.column("hi"))
    f = Cuckoo.sized(max(room, len(h)))
    f.insert(h)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


def _moved_filter(key, old, moves, room: int):
    h, way = _filter_hash(moves.column("hi")), np.asarray(moves.column("way"))
    f = Cuckoo.load(old.column("filter")[0].as_py()) if old.num_rows else Cuckoo.sized(max(room, len(h)))
    f.delete(h[way < 0])
    f.insert(h[way > 0])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})


def apply(docs: DataFrame, index: LineIndex, *, id_col="doc_id", text_col="text", kept_col="kept_text", lines_col="n_lines", dropped_col="n_dropped") -> DataFrame:
    """All columns of ``docs``, and the kept text, the number of lines before dropping and the number of lines dropped,
    under the names given; columns that have these names already are replaced. ``_ls_`` begins reserved names.

    Only documents that lose a line meet their keys by a shuffle. The others, null ids included, pass where they were
    read while the ids that lose lines can be broadcast (counted first); beyond that null ids still stay aside."""
    docs = docs.drop(kept_col, lines_col, dropped_col)
    drops = common.checkpointed(index.drops().select(F.col("id").alias("_ls_drop_id"), F.col("keys").alias("_ls_keys")))
    min_chars = index.min_chars
    text_at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            kept, n, d = [], [], []
            lists = batch.column(batch.num_columns - 1)
            inner = lists.flatten()
            raw = np.column_stack([np.asarray(inner.field(0)), np.asarray(inner.field(1))]).astype("<i8").tobytes()
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).tolist()
            at = 0
            for text, k in zip(batch.column(text_at), size):
                text = text.as_py() or ""
                lost = {raw[i : i + 16] for i in range(at, at + 16 * k, 16)}
                at += 16 * k
                ls = text.split("\n")
                rest = [line for line, key in zip(ls, keys(ls, min_chars)) if key not in lost]
                kept.append("\n".join(rest))
                n.append(len(ls))
                d.append(len(ls) - len(rest))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=[*batch.schema.names[:-1], kept_col, lines_col, dropped_col])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(kept_col, T.StringType()), T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())])
    own = F.col("_ls_text")
    whole = lambda df: df.withColumn("_ls_text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).select(
        *[F.col(f"`{c}`") for c in docs.columns], own.alias(kept_col), (F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1).cast("long").alias(lines_col), F.lit(0).cast("long").alias(dropped_col)
    )
    same = docs[id_col] == F.col("_ls_drop_id")
    if drops.count() * 64 <= common.BROADCAST_LIMIT:
        ids = F.broadcast(drops.select("_ls_drop_id"))
        changed = docs.join(ids, same, "left_semi").join(drops.hint("shuffle_hash"), same).drop("_ls_drop_id")
        return map_arrow(changed, run, schema).unionByName(whole(docs.join(ids, same, "left_anti")))
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    met = named.join(drops.hint("shuffle_hash"), named[id_col] == F.col("_ls_drop_id"), "left").drop("_ls_drop_id")
    return map_arrow(met, run, schema).unionByName(whole(docs.where(F.col(f"`{id_col}`").isNull())))
