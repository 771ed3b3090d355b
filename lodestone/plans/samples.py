"""Archives and streams of formats that the library only reads, made from rows so that queries can read them back."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def cpio(files: list[tuple[str, bytes]]) -> bytes:
    """The new portable format: a header of hexadecimal fields, name and content, each padded to four bytes."""
    out = []
    for name, body, mode in [*((n, c, 0o100644) for n, c in files), ("TRAILER!!!", b"", 0)]:
        raw = name.encode() + b"\0"
        head = b"070701" + b"".join(b"%08x" % x for x in (1, mode, 0, 0, 1, 1000, len(body), 0, 0, 0, 0, len(raw), 0)) + raw
        out += [head, b"\0" * (-len(head) % 4), body, b"\0" * (-len(body) % 4)]
    return b"".join(out)


def ar(files: list[tuple[str, bytes]]) -> bytes:
    """Members with names of up to 16 bytes, each padded to two bytes."""
    out = [b"!<arch>\n"]
    for name, body in files:
        out += [b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (name.encode(), 0, 0, 0, b"100644", len(body)), body, b"\n" * (len(body) & 1)]
    return b"".join(out)


def szdd(data: bytes) -> bytes:
    """Literals only: a byte of flags before every eight."""
    return b"SZDD\x88\xf0\x27\x33A\0" + struct.pack("<I", len(data)) + b"".join(b"\xff" + data[i : i + 8] for i in range(0, len(data), 8))


def lzop(data: bytes) -> bytes:
    """Stored blocks with checksums."""
    head = b"\x89LZO\0\r\n\x1a\n" + struct.pack(">HHHBBIIIIB", 0x1030, 0x2080, 0x0940, 1, 5, 1, 0o644, 0, 0, 0)
    out = [head, struct.pack(">I", zlib.adler32(head[9:]))]
    for i in range(0, len(data), 1 << 18):
        part = data[i : i + (1 << 18)]
        out += [struct.pack(">III", len(part), len(part), zlib.adler32(part)), part]
    return b"".join([*out, b"\0\0\0\0"])


def compress(data: bytes) -> bytes:
    """Unix compress without block mode and with codes of nine bits: single bytes, whatever else the table could say."""
    bits, n = 0, 0
    out = bytearray(b"\x1f\x9d\x09")
    for c in data:
        bits |= c << n
        n += 9
        while n >= 8:
            out.append(bits & 255)
            bits, n = bits >> 8, n - 8
    if n:
        out.append(bits & 255)
    return bytes(out)


ARCHIVES = {"CPIO": cpio, "AR": ar}
STREAMS = {"MSLZ": szdd, "LZOP": lzop, "Z": compress}


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """One archive per value of ``archive``: (path, content), from (archive, name, content)."""
    ship(rows.sparkSession)
    build = ARCHIVES[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", kind="stable")
        return pd.DataFrame({"path": [pdf["archive"].iloc[0]], "content": [build([(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"])])]})

    return rows.select("archive", "name", "content").groupBy("archive").applyInPandas(run, "path string, content binary")


def streamed(rows: DataFrame, kind: str, content: str = "content", out: str = "packed") -> DataFrame:
    ship(rows.sparkSession)
    build = STREAMS[kind]

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: build(bytes(b)))

    return rows.withColumn(out, run(content))
