"""Formats: names, extensions and detection by content or name, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format names and the extensions that stand for them.
EXTENSIONS = {
    "TAR_GZ": "tar.gz tgz",
    "TAR_XZ": "tar.xz txz",
    "TAR_BZ2": "tar.bz2 tbz2 tbz",
    "TAR_BROTLI": "tar.br tbr",
    "TAR_LZIP": "tar.lz tlz",
    "TAR_LZOP": "tar.lzo tzo",
    "TAR_ZSTD": "tar.zst tzst",
    "TAR_LZ4": "tar.lz4 tlz4",
    "TAR": "tar gem",
    "RAR": "rar cbr",
    "ZIP": "zip jar war ear apk ipa xpi crx vsix nupkg kmz aar whl egg cbz xps oxps fcstd 3mf docx docm dotx dotm xlsx xlsm xltx xltm pptx pptm potx potm odt ods odp odg odf odb odc odm epub",
    "GZIP": "gz gzip",
    "BZIP2": "bz2 bzip2",
    "SEVEN_Z": "7z cb7",
    "XZ": "xz",
    "ZSTD": "zst zstd",
    "LZ4": "lz4",
    "SNAPPY": "snappy",
    "CPIO": "cpio",
    "LZMA": "lzma",
    "LZIP": "lz",
    "LZOP": "lzo",
    "Z": "z",
    "AR": "a deb",
    "RPM": "rpm",
    "XAR": "xar",
    "LHA": "lzh lha",
    "ARJ": "arj",
    "CAB": "cab",
    "BROTLI": "br",
    "ISO": "iso",
    "UDF": "udf",
    "ADF": "adf",
    "WIM": "wim swm esd",
    "DMG": "dmg sparseimage",
    "SQUASHFS": "sqfs squashfs snap",
    "OLE": "msi msp",
    "CHM": "chm",
}

# Labels of the formats.
LABELS = {
    "ZIP": "ZIP", "GZIP": "GZIP", "BZIP2": "BZIP2", "TAR": "TAR", "TAR_GZ": "TAR+GZIP", "TAR_BZ2": "TAR+BZIP2", "RAR": "RAR",
    "ZSTD": "Zstandard", "SEVEN_Z": "7-Zip", "XZ": "XZ", "TAR_XZ": "TAR+XZ", "LZ4": "LZ4", "TAR_LZ4": "TAR+LZ4",
    "TAR_ZSTD": "TAR+Zstandard", "SNAPPY": "Snappy", "CPIO": "CPIO", "LZMA": "LZMA", "Z": "Unix compress", "AR": "AR",
    "RPM": "RPM", "XAR": "XAR", "ISO": "ISO 9660", "UDF": "UDF", "WIM": "WIM", "SQUASHFS": "SquashFS", "ADF": "Amiga disk image",
    "DMG": "Apple disk image", "OLE": "OLE compound file", "CHM": "CHM", "ARJ": "ARJ", "MSLZ": "MS compress (SZDD)", "LHA": "LHA/LZH",
    "CAB": "Cabinet", "BROTLI": "Brotli", "TAR_BROTLI": "TAR+Brotli", "LZIP": "lzip", "TAR_LZIP": "TAR+lzip", "LZOP": "lzop",
    "TAR_LZOP": "TAR+lzop", "SFX": "Self-extracting executable", "UNKNOWN": "Unknown",
}

# First bytes of the formats, in the order in which they are tried.
MAGIC = [
    ("RAR", "526172211a0700"), ("RAR", "526172211a070100"), ("ZIP", "504b"), ("GZIP", "1f8b"), ("BZIP2", "425a68"), ("SEVEN_Z", "377abcaf271c"),
    ("ZSTD", "28b52ffd"), ("XZ", "fd377a585a00"), ("LZ4", "04224d18"), ("SNAPPY", "ff060000734e61507059"), ("LZIP", "4c5a4950"),
    ("LZOP", "894c5a4f000d0a1a0a"), ("CPIO", "303730373031"), ("CPIO", "303730373032"), ("CPIO", "303730373037"), ("Z", "1f9d"),
    ("AR", "213c617263683e0a"), ("RPM", "edabeedb"), ("XAR", "78617221"), ("CAB", "4d534346"), ("WIM", "4d5357494d000000"), ("SQUASHFS", "68737173"),
    ("OLE", "d0cf11e0a1b11ae1"), ("DMG", "656e637263647361"), ("CHM", "49545346"), ("MSLZ", "535a444488f02733"),
]

#: Single streams, and what they are with a TAR inside.
TAR_OF = {"GZIP": "TAR_GZ", "BZIP2": "TAR_BZ2", "XZ": "TAR_XZ", "ZSTD": "TAR_ZSTD", "LZ4": "TAR_LZ4", "BROTLI": "TAR_BROTLI", "LZIP": "TAR_LZIP", "LZOP": "TAR_LZOP"}


def formats(spark: SparkSession) -> DataFrame:
    """The catalog: format, label, extensions."""
    return spark.createDataFrame([(f, LABELS[f], EXTENSIONS.get(f, "").split()) for f in LABELS if f != "UNKNOWN"], "format string, label string, extensions array<string>")


def extensions(spark: SparkSession) -> DataFrame:
    """One row per extension."""
    return formats(spark).select(F.explode("extensions").alias("extension"), "format")


def _hex(x: str) -> Column:
    return F.unhex(F.lit(x))


def _byte(col: Column, at: int) -> Column:
    """Unsigned byte at an offset."""
    return F.conv(F.hex(F.substring(col, at + 1, 1)), 16, 10).cast("int")


def by_magic(content: Column) -> Column:
    """Format by the first bytes; null if none is known."""
    head = F.substring(content, 1, 512)
    out = reduce(lambda c, m: c.when(F.startswith(head, _hex(m[1])), m[0]), MAGIC[1:], F.when(F.startswith(head, _hex(MAGIC[0][1])), MAGIC[0][0]))
    arj_size = _byte(head, 2) + 256 * _byte(head, 3)
    out = out.when(F.startswith(head, _hex("60ea")) & (arj_size > 0) & (arj_size <= 2600) & (_byte(head, 10) == 2), "ARJ")
    out = out.when(F.substring(head, 3, 3) == _hex("2d6c68"), "LHA")
    out = out.when(F.substring(head, 258, 5) == _hex("7573746172"), "TAR")
    return out.when(F.startswith(head, _hex("4d5a")) | F.startswith(head, _hex("7f454c46")), "SFX")


def by_trailer(content: Column) -> Column:
    """DMG: the trailer in the last 512 bytes."""
    tail = F.substring(content, -512, 12)
    return F.when((F.octet_length(content) >= 512) & F.startswith(tail, _hex("6b6f6c79")) & (F.substring(tail, 9, 4) == _hex("00000200")), "DMG")


def by_disc(content: Column) -> Column:
    """Disk images, which have their marks far inside."""
    length = F.octet_length(content)
    adf = length.isin(901120, 1802240) & F.startswith(content, _hex("444f53")) & (_byte(content, 3) <= 7)
    sector = lambda i: F.substring(content, i * 2048 + 2, 5)
    udf = (length >= 34 * 2048) & F.exists(F.sequence(F.lit(16), F.lit(31)), lambda i: sector(i).isin(bytearray(b"NSR02"), bytearray(b"NSR03")))
    iso = (length >= 32774) & (F.substring(content, 32770, 5) == _hex("4344303031"))
    return F.when(adf, "ADF").when(udf, "UDF").when(iso, "ISO")


def by_extension(name: Column) -> Column:
    """Format by the longest known extension of a name; null if none is known."""
    low = F.lower(name)
    pairs = sorted(((e, f) for f, es in EXTENSIONS.items() for e in es.split()), key=lambda p: -len(p[0]))
    return reduce(lambda c, p: c.when(F.endswith(low, F.lit("." + p[0])), p[1]), pairs[1:], F.when(F.endswith(low, F.lit("." + pairs[0][0])), pairs[0][1]))


def detect(content: Column, name: Column) -> Column:
    """Content first (trailer, magic, disc), then the name; a stream whose name says TAR becomes a TAR of its kind."""
    found = F.coalesce(by_trailer(content), by_magic(content), by_disc(content), by_extension(name), F.lit("UNKNOWN"))
    named = by_extension(name)
    inner = reduce(lambda c, p: c.when((found == p[0]) & (named == p[1]), p[1]), list(TAR_OF.items())[1:], F.when((found == "GZIP") & (named == "TAR_GZ"), "TAR_GZ"))
    return F.coalesce(inner, found)
