"""Recovery of damaged archives: what can be had of each file, with its reliability."""

from __future__ import annotations

import bisect
import bz2
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import codecs, formats
from ..shipping import ship
from ..sources import registry, simple
from ..sources.base import ArchiveError
from ..sources.zip import inflate


def _name(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp437")


def zip_files(data: bytes):
    """Local headers, wherever they stand: the central directory isn't needed."""
    marks = [m.start() for m in re.finditer(b"PK\x03\x04", data)]
    ends = [m.start() for m in re.finditer(b"PK\x01\x02|PK\x05\x06", data)]
    skip, view, bounds = 0, memoryview(data), sorted({*marks, *ends, len(data)})
    for o in marks:
        if o < skip or o + 30 > len(data):
            continue
        flags, method, _, _, crc, packed, plain, n, m = struct.unpack_from("<HHHHIIIHH", data, o + 6)
        if o + 30 + n > len(data) or not n:
            continue
        name, start = _name(data[o + 30 : o + 30 + n]), o + 30 + n + m
        later = bounds[min(bisect.bisect_right(bounds, o), len(bounds) - 1)]
        known = not flags & 8
        raw = view[start : start + packed] if known else view[start:]
        if name.endswith("/"):
            continue
        if flags & 1:
            yield name, "LOST", b"", plain if known else None, "encrypted"
            continue
        if method == 8:
            d, out = zlib.decompressobj(-15), bytearray()
            try:
                for i in range(0, len(raw), 4096):
                    out += d.decompress(raw[i : i + 4096])
                    fed = min(i + 4096, len(raw))
                    if d.eof:
                        break
            except zlib.error as e:
                yield name, "PARTIAL" if out else "LOST", bytes(out), plain if known else None, str(e)
                continue
            if not d.eof:
                yield name, "PARTIAL" if out else "LOST", bytes(out), plain if known else None, "data end early"
                continue
            body = bytes(out)
            if not known:
                used = fed - len(d.unused_data)
                tail = data[start + used : start + used + 16]
                crc = struct.unpack_from("<I", tail, 4 if tail[:4] == b"PK\x07\x08" else 0)[0] if len(tail) >= 8 else None
        elif method == 0:
            body = bytes(raw) if known else data[start:later]
            if known and len(body) < packed:
                yield name, "PARTIAL" if body else "LOST", body, plain, "data end early"
                continue
        else:
            try:
                body = inflate(method, bytes(raw) if known else data[start:later], plain)
            except ArchiveError as e:
                yield name, "LOST", b"", plain if known else None, str(e)
                continue
        skip = start + (packed if known else 0)
        ok = None if crc is None else zlib.crc32(body) == crc
        yield name, "OK" if ok else "UNVERIFIED" if ok is None else "BAD_CHECKSUM", body, plain if known else len(body), None if ok else "no checksum" if ok is None else "CRC doesn't fit"


def _pax(raw: bytes) -> dict[bytes, bytes]:
    """Records "length key=value" of a pax header, as far as they can be read."""
    out, p = {}, 0
    while p < len(raw):
        digits = raw[p : p + 20].split(b" ")[0]
        n = int(digits) if digits.isdigit() else 0
        key, mark, value = raw[p + len(digits) + 1 : p + n - 1].partition(b"=")
        if n <= len(digits) or not mark:
            break
        out[key] = value
        p += n
    return out


def _next_tar_header(data: bytes, p: int) -> int:
    """The first header after damage: a ustar mark at any offset, or a 512-byte step from the start or from p; its
    checksum must fit."""
    m = data.find(b"ustar", p + 258)
    while m >= 0 and not (m + 255 <= len(data) and _sum_fits(data[m - 257 : m + 255])):
        m = data.find(b"ustar", m + 1)
    end = m - 257 if m >= 0 else len(data)
    for first in {p + 512, p + 512 - p % 512}:
        for q in range(first, min(end, len(data) - 511), 512):
            if data[q] and _sum_fits(data[q : q + 512]):
                end = min(end, q)
                break
    return end


def tar_files(data: bytes):
    """Headers at 512-byte steps whose checksum fits, with GNU long names and pax paths and sizes; after damage the
    next header is looked for."""
    p, rows, long, pax = 0, [], None, {}
    while p + 512 <= len(data):
        h = data[p : p + 512]
        if not h.strip(b"\0"):
            p += 512
            continue
        if not simple._is_tar(h) or not _sum_fits(h):
            if rows and rows[-1][1] == "UNVERIFIED":
                rows[-1][4] = "followed by damage"
            p, long, pax = _next_tar_header(data, p), None, {}
            continue
        try:
            size = int.from_bytes(h[125:136], "big") if h[124] & 0x80 else int(h[124:136].strip(b"\0 ") or b"0", 8)
        except ValueError:
            p, long, pax = p + 512, None, {}
            continue
        kind = h[156:157]
        if kind in b"LKxXg":
            body = data[p + 512 : p + 512 + size]
            if kind == b"L":
                long = body.split(b"\0")[0]
            elif kind in b"xX":
                pax = _pax(body)
            p += 512 + -(-size // 512) * 512
            continue
        if pax.get(b"size", b"").isdigit():
            size = int(pax[b"size"])
        short = h[345:500].split(b"\0")[0] + b"/" + h[:100].split(b"\0")[0] if h[257:262] == b"ustar" and h[345] else h[:100].split(b"\0")[0]
        name = _name(pax.get(b"path") or long or short)
        long, pax = None, {}
        body = data[p + 512 : p + 512 + size]
        if kind in (b"0", b"\0", b"7"):
            whole = len(body) == size
            rows.append([name, "UNVERIFIED" if whole else "PARTIAL" if body else "LOST", body, size, None if whole else "data end early"])
        p += 512 + -(-size // 512) * 512
    yield from map(tuple, rows)


def _sum_fits(h: bytes) -> bool:
    try:
        return int(h[148:156].strip(b"\0 ") or b"x", 8) == sum(h[:148]) + 256 + sum(h[156:])
    except ValueError:
        return False


def bzip2_blocks(data: bytes):
    """Blocks that still decode, found at any bit by their 48-bit mark, each in a stream of its own."""
    start, end, total = 0x314159265359, 0x177245385090, len(data) * 8
    marks = sorted({(at, mark) for mark in (start, end) for at in _bit_places(data, mark)})
    level = data[3:4] if data[:3] == b"BZh" else b"9"
    for i, (a, mark) in enumerate(marks):
        if mark != start:
            continue
        b = marks[i + 1][0] if i + 1 < len(marks) else total
        body = _bits(data, a, b)
        crc = _bits(data, a + 48, min(a + 80, b))
        raw = (body << 80 | end << 32 | crc) << (pad := -(b - a + 80) % 8)
        try:
            yield bz2.decompress(b"BZh" + level + raw.to_bytes((b - a + 80 + pad) // 8, "big"))
        except (OSError, ValueError, EOFError):
            yield None


def _bits(data: bytes, a: int, b: int) -> int:
    """The bits from a to b as a number."""
    return int.from_bytes(data[a >> 3 : (b + 7) >> 3], "big") >> (-b % 8) & ((1 << (b - a)) - 1)


def _bit_places(data: bytes, mark: int):
    """Where a 48-bit mark stands, at any bit: its whole inner bytes are searched for each of the eight shifts, and the
    bits on both sides compared."""
    for shift in range(8):
        inner = (mark if shift == 0 else mark >> (8 - shift)) & ((1 << 40) - 1)
        needle, at = inner.to_bytes(5, "big"), 0
        while (at := data.find(needle, at)) >= 0:
            # the inner bytes begin shift bits after the mark's start where it isn't on a byte
            a = 8 * at - (8 if shift == 0 else shift)
            if a >= 0 and a + 48 <= 8 * len(data) and _bits(data, a, a + 48) == mark:
                yield a
            at += 1


def recover_one(path: str, kind: str, data: bytes):
    """(name, status, content, expected size, message) of what can be had."""
    base = path.rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0] if "." in base else base
    if kind == "ZIP" or kind == "SFX" and b"PK\x03\x04" in data:
        yield from zip_files(data)
    elif kind == "TAR":
        yield from tar_files(data)
    elif kind in codecs.DECODERS or kind in formats.TAR_OF.values():
        codec = {v: k for k, v in formats.TAR_OF.items()}.get(kind, kind)
        if codec == "BZIP2":
            try:
                body, whole = codecs.decompress(codec, data), True
            except ArchiveError:
                got = list(bzip2_blocks(data))
                body, whole = b"".join(x for x in got if x), bool(got) and all(x is not None for x in got)
        else:
            body, whole = codecs.partial(codec, data)
        if simple._is_tar(body[:512]):
            yield from tar_files(body)
        else:
            yield stem, "OK" if whole else "PARTIAL" if body else "LOST", body, None, None if whole else "damaged stream"
    else:
        try:
            for e in registry.parse(data, kind, path):
                if e.is_directory or e.link_target is not None:
                    continue
                if e.error:
                    yield e.name, "BAD_CHECKSUM" if "CRC" in str(e.error) else "LOST", b"", e.uncompressed_size, str(e.error)
                else:
                    yield e.name, "OK" if e.crc32 is not None else "UNVERIFIED", e.content or b"", e.uncompressed_size, None
        except ArchiveError as x:
            yield None, "LOST", b"", None, f"{x.kind}: {x}"


def recover(archives: DataFrame) -> DataFrame:
    """Files of damaged archives given as (path, content) rows; never fails on content."""
    ship(archives.sparkSession)
    rows = archives.select("path", formats.detect(F.col("content"), F.col("path")).alias("format"), "content")
    names = schemas.RECOVERED.names

    def run(batches):
        for pdf in batches:
            for path, kind, content in zip(pdf["path"], pdf["format"], pdf["content"]):
                out = [(path, i, n, s, len(c), size, why, c) for i, (n, s, c, size, why) in enumerate(recover_one(path, kind, bytes(content or b"")))]
                if out:
                    yield pd.DataFrame({n: pd.Series([r[j] for r in out], dtype=object) for j, n in enumerate(names)})

    return rows.mapInPandas(run, schemas.RECOVERED)


def summary(recovered: DataFrame) -> DataFrame:
    """One row per archive: how many files have each status, and the sentence that says so."""
    counts = recovered.groupBy("archive_path").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in schemas.STATUSES])
    return counts.withColumn("summary", F.format_string("%d ok, %d unverified, %d bad checksum, %d partial, %d lost", *[s.lower() for s in schemas.STATUSES]))
