"""Writing: rows to archives, streams to compressed streams, entries to folders."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs, formats
from ..functions.paths import safe_path
from ..shipping import ship
from ..sources import sevenzip, windows
from ..sources.base import Unsupported


def tar_bytes(files) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, content, mtime in files:
            i = tarfile.TarInfo(name.rstrip("/"))
            i.mtime = mtime or 0
            if content is None:
                i.type, i.mode = tarfile.DIRTYPE, 0o755
                t.addfile(i)
            else:
                i.size = len(content)
                t.addfile(i, io.BytesIO(content))
    return out.getvalue()


def zip_bytes(files, level: int | None = None, store: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if store else zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, content, mtime in files:
            t = pd.Timestamp(max(mtime or 0, 315_532_800), unit="s")
            i = zipfile.ZipInfo(name if content is not None or name.endswith("/") else name + "/", (t.year, t.month, t.day, t.hour, t.minute, t.second))
            i.compress_type = zipfile.ZIP_STORED if store or content is None else zipfile.ZIP_DEFLATED
            i.external_attr = (0o40755 << 16 | 0x10) if content is None else 0o100644 << 16
            z.writestr(i, content or b"", compresslevel=level)
    return out.getvalue()


def zip_aes_bytes(files, password: str, level: int | None = None, salt=os.urandom) -> bytes:
    """A ZIP whose files are encrypted with AES-256 (AE-2, so without their CRC)."""
    import hashlib
    import hmac
    import struct
    import zlib

    from ..sources.aes import AES

    body, central, n = b"", b"", 0
    for name, content, mtime in files:
        t = pd.Timestamp(max(mtime or 0, 315_532_800), unit="s")
        date, time = (t.year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2
        raw, flags, method, extra = b"", 0x800, 0, b""
        if content is None:
            name = name.rstrip("/") + "/"
        else:
            c = zlib.compressobj(-1 if level is None else level, zlib.DEFLATED, -15)
            s = salt(16)
            key = hashlib.pbkdf2_hmac("sha1", password.encode(), s, 1000, 66)
            enc = AES(key[:32]).ctr_le(c.compress(content) + c.flush())
            raw = s + key[64:] + enc + hmac.new(key[32:64], enc, hashlib.sha1).digest()[:10]
            flags, method, extra = 0x801, 99, struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, 8)
        encoded = name.encode()
        common = struct.pack("<HHHHHIIIHH", 51, flags, method, time, date, 0, len(raw), len(content or b""), len(encoded), len(extra))
        central += b"PK\x01\x02" + struct.pack("<H", 51) + common + struct.pack("<HHHII", 0, 0, 0, 0x10 if content is None else 0, len(body)) + encoded + extra
        body += b"PK\x03\x04" + common + encoded + extra + raw
        n += 1
    if len(body) + len(central) > 0xFFFFFFFF or n > 0xFFFF:
        raise Unsupported("an encrypted ZIP of more than 4 GB or 65535 files")
    return body + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), len(body), 0)


def pak_bytes(files) -> bytes:
    import struct

    at, table, body = 12, b"", b""
    for name, content, _ in files:
        if content is None:
            continue
        raw = name.encode("latin-1", "replace")
        if len(raw) > 55:
            raise Unsupported(f"name too long for a PAK: {name}")
        table += struct.pack("<56sII", raw, at, len(content))
        body += content
        at += len(content)
    return struct.pack("<4sII", b"PACK", at, len(table)) + body + table


#: Writers by format: (name, content or None for a folder, seconds or None) rows to bytes.
WRITERS = {
    "TAR": lambda f, level=None: tar_bytes(f), "ZIP": lambda f, level=None: zip_bytes(f, level), "ZIP_STORED": lambda f, level=None: zip_bytes(f, store=True),
    "SEVEN_Z": lambda f, level=None: sevenzip.write(f, level if level is not None else 6), "CAB": lambda f, level=None: windows.write_cab([x for x in f if x[1] is not None]), "PAK": lambda f, level=None: pak_bytes(f),
    **{t: (lambda c: lambda f, level=None: codecs.compress(c, tar_bytes(f), level))(c) for c, t in formats.TAR_OF.items() if c in codecs.ENCODERS},
}


def writer_for(name: str) -> str:
    """The writable format of a file name's longest extension."""
    low = name.lower()
    found = max(((len(e), f) for f, es in {**formats.EXTENSIONS, "PAK": "pak"}.items() for e in es.split() if low.endswith("." + e)), default=(0, None))[1]
    if found not in WRITERS and found not in codecs.ENCODERS:
        raise Unsupported(f"{found or name}: extraction only")
    return found


def pack(rows: DataFrame, archive: str, name: str, content: str, *, kind: str, modified: str | None = None, level: int | None = None, password: str | None = None) -> DataFrame:
    """One archive per value of ``archive``: (path, content). Entries are in name order. ZIPs can have a password.

    An archive is one value of at most 2 GB and is made in one task, as any archive is."""
    if kind not in WRITERS:
        raise Unsupported(f"{kind} can't be written")
    if password is not None and kind != "ZIP":
        raise Unsupported(f"{kind} can't be written with a password")
    ship(rows.sparkSession)
    stamp = F.col(modified).cast("long") if modified else F.lit(None).cast("long")
    t = rows.select(F.col(archive).cast("string").alias("path"), F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"), stamp.alias("mtime"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from lodestone.operators import write

        pdf = pdf.sort_values("name", kind="stable")
        files = [(n, bytes(c) if c is not None else None, None if pd.isna(m) else int(m)) for n, c, m in zip(pdf["name"], pdf["content"], pdf["mtime"])]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [write.WRITERS[kind](files, level) if password is None else write.zip_aes_bytes(files, password, level)]})

    return t.groupBy("path").applyInPandas(run, "path string, content binary")


def _mapped(rows: DataFrame, column: str, out: str, f) -> DataFrame:
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return rows.withColumn(out, run(F.col(column).cast("binary")))


def compressed(rows: DataFrame, codec: str, column: str = "content", out: str = "packed", level: int | None = None) -> DataFrame:
    return _mapped(rows, column, out, lambda b: codecs.compress(codec, b, level))


def decompressed(rows: DataFrame, codec: str, column: str = "packed", out: str = "content") -> DataFrame:
    return _mapped(rows, column, out, lambda b: codecs.decompress(codec, b))


def extract_to(entries: DataFrame, folder: str) -> DataFrame:
    """Write files below ``folder`` (which all executors must share) and return path, bytes written and error.

    Later entries of an archive replace earlier ones of the same path."""
    from .relational import last_wins

    ship(entries.sparkSession)
    files = last_wins(entries.where("name is not null").withColumn("safe_path", safe_path(F.col("name"))))

    def run(batches):
        for pdf in batches:
            out = []
            for path, content, is_dir in zip(pdf["safe_path"], pdf["content"], pdf["is_directory"]):
                target = os.path.realpath(os.path.join(folder, path))
                if not target.startswith(os.path.realpath(folder) + os.sep):
                    out.append((path, 0, "outside of the folder"))
                    continue
                os.makedirs(target if is_dir else os.path.dirname(target), exist_ok=True)
                if not is_dir and content is not None:
                    with open(target, "wb") as f:
                        f.write(bytes(content))
                out.append((path, 0 if content is None else len(content), None))
            yield pd.DataFrame(out, columns=["safe_path", "bytes_written", "error"])

    return files.select("safe_path", "content", "is_directory").mapInPandas(run, "safe_path string, bytes_written long, error string")
