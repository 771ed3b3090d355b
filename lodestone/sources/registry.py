"""Parsers by format, plugins included, and the table function that turns archives into rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import formats
from ..shipping import ship
from . import discs, sevenzip, simple, windows
from . import zip as zip_
from .base import ArchiveError, Corrupted, Entry, LimitExceeded, Unsupported


def _sfx(data: bytes, want: bool = True, **kw) -> Iterator[Entry]:
    """The largest archive inside an executable; a ZIP at its end is read in place."""
    from ..operators.carve import pieces

    found = [p for p in pieces(data) if p["type"] in ("zip", "7z", "rar", "cab") and p["offset"] > 0]
    if not found:
        raise Unsupported("no archive inside the executable")
    best = max(found, key=lambda p: p["length"])
    kind = {"zip": "ZIP", "7z": "SEVEN_Z", "rar": "RAR", "cab": "CAB"}[best["type"]]
    yield from PARSERS[kind](data[best["offset"] : best["offset"] + best["length"]], want, **kw)


def _tar_in(codec: str):
    from ..functions.codecs import decompress

    return lambda data, want=True, **_: simple.tar(decompress(codec, data), want)


PARSERS: dict[str, Callable[..., Iterator[Entry]]] = {
    "ZIP": zip_.entries, "SEVEN_Z": sevenzip.entries, "TAR": simple.tar, "CPIO": simple.cpio, "AR": simple.ar, "RPM": simple.rpm, "XAR": simple.xar,
    "CAB": windows.cab, "OLE": windows.ole, "CHM": windows.chm, "LHA": windows.lha, "ARJ": windows.arj, "RAR": windows.rar,
    "ISO": discs.iso, "SQUASHFS": discs.squashfs, "ADF": discs.adf, "WIM": discs.wim, "DMG": discs.dmg, "UDF": discs.udf, "SFX": _sfx,
    **{c: simple.stream(c) for c in ("GZIP", "BZIP2", "XZ", "LZMA", "ZSTD", "LZ4", "SNAPPY", "BROTLI", "LZIP", "LZOP", "Z", "MSLZ")},
    **{t: _tar_in(c) for c, t in formats.TAR_OF.items()},
}


@dataclass(frozen=True)
class Plugin:
    """A further format. ``matches`` gets the first bytes and the name; a positive priority goes before built-in
    formats. ``parse`` yields entries; the other functions are optional."""

    id: str
    name: str
    version: str
    author: str
    source_url: str
    license: str
    matches: Callable[[bytes, str], bool]
    parse: Callable[..., Iterator[Entry]]
    extensions: tuple[str, ...] = ()
    priority: int = 0
    write: Callable | None = None
    analyze: Callable | None = None
    probe: Callable | None = None
    recover: Callable | None = None


@dataclass
class Registry:
    """Plugins that were registered explicitly, and those that were refused, with the reason."""

    plugins: dict[str, Plugin] = field(default_factory=dict)
    refused: list[tuple[str, str]] = field(default_factory=list)

    def register(self, p: Plugin) -> bool:
        missing = [k for k in ("id", "name", "version", "author", "source_url", "license") if not getattr(p, k)]
        reason = f"missing {', '.join(missing)}" if missing else "id is taken" if p.id in self.plugins or p.id.upper() in PARSERS else ""
        if reason:
            self.refused.append((p.id, reason))
            return False
        self.plugins[p.id] = p
        return True

    def ordered(self) -> list[Plugin]:
        return sorted(self.plugins.values(), key=lambda p: -p.priority)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, p.name, p.version, p.license, list(p.extensions), p.priority, True, None) for p in self.ordered()] + [(i, None, None, None, [], 0, False, why) for i, why in self.refused]
        return spark.createDataFrame(rows, "id string, name string, version string, license string, extensions array<string>, priority int, loaded boolean, reason string")


BUILT_IN = Registry()
BUILT_IN.register(Plugin("pak", "Quake PAK", "1", "lodestone", "https://example.org/lodestone", "Apache-2.0", lambda h, n: h[:4] == b"PACK", simple.pak, ("pak",)))
BUILT_IN.register(Plugin("sarc", "SARC", "1", "lodestone", "https://example.org/lodestone", "Apache-2.0", lambda h, n: h[:4] == b"SARC" or h[:4] == b"Yaz0" and h[17:21] == b"SARC", simple.sarc, ("sarc", "szs", "pack")))


@dataclass(frozen=True)
class Limits:
    """Bounds of what one archive may decode to; 0 is none."""

    max_total: int = 0
    max_ratio: int = 1000
    ratio_threshold: int = 1 << 30

    def check(self, total: int, size: int) -> None:
        if self.max_total and total > self.max_total:
            raise LimitExceeded(f"more than {self.max_total} bytes")
        if self.max_ratio and total > self.ratio_threshold and total // max(1, size) > self.max_ratio:
            raise LimitExceeded(f"more than {self.max_ratio} times the archive")


def parse(data: bytes, kind: str | None, name: str = "", *, want: bool = True, password: str | None = None, plugins: list[Plugin] = (), limits: Limits = Limits()) -> Iterator[Entry]:
    """Entries of one archive. Raises what stops it; entries with an error of their own don't."""
    chosen = next((p for p in plugins if p.priority > 0 and p.matches(data[: 4 << 20], name)), None)
    if chosen is None and kind in (None, "UNKNOWN"):
        chosen = next((p for p in plugins if p.matches(data[: 4 << 20], name)), None)
    run = chosen.parse if chosen else PARSERS.get(kind or "UNKNOWN")
    if run is None:
        raise Unsupported(f"format {kind}") if data else Corrupted("empty file")
    total = 0
    try:
        for e in run(data, want, name=name, password=password):
            total += len(e.content) if e.content is not None else 0
            limits.check(total, len(data))
            yield e
    except ArchiveError:
        raise
    except (ValueError, IndexError, KeyError, OverflowError, MemoryError, RecursionError, EOFError, OSError, StopIteration) as x:
        raise Corrupted(f"{type(x).__name__}: {x}") from x


def entry_rows(path: str, kind: str, data: bytes, **kw) -> Iterator[tuple]:
    """Rows of the entry schema; an archive that can't be read ends with a row that has its error."""
    n = 0
    try:
        for e in parse(data, kind, path, **kw):
            digest = hashlib.sha256(e.content).hexdigest() if e.content is not None else None
            error = {"class": e.error.kind, "message": str(e.error)} if e.error else None
            modified = pd.Timestamp(e.modified, unit="s") if e.modified is not None and abs(e.modified) < 1 << 33 else None
            yield (path, n, e.name, e.compressed_size, e.uncompressed_size, modified, e.is_directory, e.is_encrypted, e.crc32, kind, e.method, e.mode, e.link_target, e.comment, digest, e.content, error)
            n += 1
    except ArchiveError as x:
        yield (path, n, None, None, None, None, None, None, None, kind, None, None, None, None, None, None, {"class": x.kind, "message": str(x)})


def read_entries(archives: DataFrame, *, want_content: bool = True, password: str | None = None, limits: Limits = Limits(), registry: Registry = BUILT_IN, failfast: bool = False) -> DataFrame:
    """Entries of archives given as (path, content) rows, such as ``binaryFile`` gives, with a format column if there
    is one. One archive is one task's work; rows come in archive order, numbered by ``entry_index``.

    With ``want_content`` off nothing is decoded that listing doesn't need. Errors are rows; ``failfast`` raises."""
    spark = archives.sparkSession
    kind = F.col("format") if "format" in archives.columns else formats.detect(F.col("content"), F.col("path"))
    rows = archives.select("path", kind.alias("format"), "content")
    plugins = registry.ordered()
    schema, names = schemas.ENTRY, schemas.ENTRY.names
    ship(spark)

    def run(batches):
        for pdf in batches:
            for path, k, content in zip(pdf["path"], pdf["format"], pdf["content"]):
                block, size = [], 0
                for row in entry_rows(path, k, bytes(content if content is not None else b""), want=want_content, password=password, plugins=plugins, limits=limits):
                    if failfast and row[-1]:
                        raise ArchiveError(f"{path}: {row[-1]['class']}: {row[-1]['message']}")
                    block.append(row)
                    size += len(row[15] or b"")
                    if len(block) >= 4096 or size > 32 << 20:
                        yield _frame(block, names)
                        block, size = [], 0
                if block:
                    yield _frame(block, names)

    return rows.mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})
    out["modified"] = pd.to_datetime(out["modified"])
    return out


def read_files(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Entries of all archives below a path (a glob too). Volumes of a split archive (``.001``, ``.002`` ...) are
    joined by their base name."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return read_entries(join_volumes(files), **kw)


def join_volumes(files: DataFrame) -> DataFrame:
    """Files as they are, and the volumes of each split archive as one row in the order of their numbers.

    A set is one archive, so its bytes meet in one task as any archive's do."""
    number = F.regexp_extract("path", r"\.([0-9]{3})$", 1)
    single = files.where(number == "").select("path", "content")
    sets = files.where(number != "").select(F.regexp_replace("path", r"\.[0-9]{3}$", "").alias("path"), number.alias("n"), "content")
    joined = sets.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("v"))
    return single.unionByName(joined.select("path", F.aggregate("v.content", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("content")))


def volume_totals(files: DataFrame) -> DataFrame:
    """Total size and number of volumes of each split archive."""
    number = F.regexp_extract("path", r"\.([0-9]{3})$", 1)
    return files.where(number != "").groupBy(F.regexp_replace("path", r"\.[0-9]{3}$", "").alias("path")).agg(F.count("*").alias("volumes"), F.sum("length").alias("total_bytes"))
