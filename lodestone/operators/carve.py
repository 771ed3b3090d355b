"""Carving: files inside a file, by their signatures and exact sizes; the pieces tile the file."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame

from .. import schemas
from ..shipping import ship

MORE = 1 << 62  # "to some place beyond the end"


def _png(d, o):
    p = o + 8
    while p + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if not kind.isalpha():
            return None
        p += 12 + n
        if kind == b"IEND":
            return p - o
    return MORE


def _jpeg(d, o):
    p = o + 2
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return None
        kind = d[p + 1]
        if kind == 0xD9:
            return p + 2 - o
        if 0xD0 <= kind <= 0xD8 or kind == 1:
            p += 2
            continue
        p += 2 + struct.unpack_from(">H", d, p + 2)[0]
        if kind == 0xDA:
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return MORE
    return MORE


def _gif(d, o):
    p = o + 13
    if p > len(d):
        return MORE
    if d[o + 10] & 0x80:
        p += 3 << ((d[o + 10] & 7) + 1)

    def blocks(p):
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - o
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 <= len(d):
            flag = d[p + 9]
            p += 10 + (3 << ((flag & 7) + 1) if flag & 0x80 else 0)
            p = blocks(p + 1)
        else:
            return None
    return MORE


def _riff(d, o):
    n = struct.unpack_from("<I", d, o + 4)[0] + 8
    return n + n % 2 if d[o + 8 : o + 12].strip(b" ").isalnum() else None


def _pdf(d, o):
    end, p = None, o
    while (p := d.find(b"%%EOF", p)) >= 0:
        nxt = d.find(b"%PDF-", o + 5, p)
        if nxt >= 0:
            break
        end = p = p + 5
    if end is None:
        return MORE
    while end < len(d) and d[end] in b"\r\n":
        end += 1
    return end - o


def _zip(d, o):
    p = o
    while (p := d.find(b"PK\x05\x06", p)) >= 0:
        if p + 22 <= len(d):
            size, off, note = struct.unpack_from("<IIH", d, p + 12)
            if off + size <= p - o and (off == 0xFFFFFFFF or d[o + off : o + off + 4] in (b"PK\x01\x02", b"PK\x05\x06")):
                return p + 22 + note - o
            if off == 0xFFFFFFFF:
                return p + 22 + note - o
        p += 4
    return MORE if struct.unpack_from("<H", d, o + 4)[0] < 100 else None


def _sevenz(d, o):
    if zlib.crc32(d[o + 12 : o + 32]) != struct.unpack_from("<I", d, o + 8)[0]:
        return None
    off, size = struct.unpack_from("<QQ", d, o + 12)
    return 32 + off + size


def _rar4(d, o):
    p = o + 7
    while p + 7 <= len(d):
        _, kind, flags, size = struct.unpack_from("<HBHH", d, p)
        if size < 7 or not 0x72 <= kind <= 0x7B:
            return None
        more = struct.unpack_from("<I", d, p + 7)[0] if (flags & 0x8000 or kind == 0x74) and p + 11 <= len(d) else 0
        if kind in (0x74, 0x7A) and flags & 0x100 and p + 36 <= len(d):  # the sizes' high halves follow the attributes
            more += struct.unpack_from("<I", d, p + 32)[0] << 32
        p += size + more
        if kind == 0x7B:
            return p - o
    return MORE


def _rar5(d, o):
    def vint(p):
        v = shift = 0
        while p < len(d):
            v |= (d[p] & 0x7F) << shift
            shift, p = shift + 7, p + 1
            if d[p - 1] < 0x80:
                break
        return v, p

    p = o + 8
    while p + 6 <= len(d):
        size, q = vint(p + 4)
        end = q + size
        kind, q = vint(q)
        flags, q = vint(q)
        if flags & 1:
            _, q = vint(q)
        body = vint(q)[0] if flags & 2 else 0
        p = end + body
        if kind == 5:
            return p - o
        if not 1 <= kind <= 5:
            return None
    return MORE


def _cab(d, o):
    n = struct.unpack_from("<I", d, o + 8)[0]
    return n if n >= 36 and d[o + 25] == 1 else None


def _gzip(d, o):
    if d[o + 2] != 8 or d[o + 3] & 0xE0:
        return None
    p, out = o, 0
    while d[p : p + 3] == b"\x1f\x8b\x08":
        z = zlib.decompressobj(31)
        try:
            for i in range(p, len(d), 1 << 20):
                out += len(z.decompress(d[i : i + (1 << 20)]))
                if z.eof:
                    p = i + min(1 << 20, len(d) - i) - len(z.unused_data)
                    break
            else:
                return MORE
        except zlib.error:
            return None if p == o and not out else MORE if p == o else p - o
    return p - o


def _xz(d, o):
    p = o + 12
    while (p := d.find(b"YZ", p)) >= 0:
        f = p - 10
        back = struct.unpack_from("<I", d, f + 4)[0] if f > o else 0
        size = (back + 1) * 4
        if f > o and zlib.crc32(d[f + 4 : f + 10]) == struct.unpack_from("<I", d, f)[0] and f - size >= o + 12 and d[f - size] == 0 and d[f + 8 : f + 10] == d[o + 6 : o + 8]:
            return p + 2 - o
        p += 2
    return MORE


def _ole(d, o):
    size = 1 << struct.unpack_from("<H", d, o + 30)[0]
    if size not in (512, 4096):
        return None
    n = struct.unpack_from("<I", d, o + 44)[0]
    sectors, more = list(struct.unpack_from("<109I", d, o + 76)), struct.unpack_from("<I", d, o + 68)[0]
    seen = set()
    while len(sectors) < n and more < 0xFFFFFFFA and more not in seen:  # further places of FAT sectors, in a chain
        seen.add(more)
        at = o + (more + 1) * size
        if at + size > len(d):
            return MORE
        *own, more = struct.unpack_from(f"<{size // 4}I", d, at)
        sectors += own
    last = max(seen, default=0)
    for i, s in enumerate(sectors[:n]):
        at = o + (s + 1) * size
        if s >= 0xFFFFFFFA or at + size > len(d):
            return MORE
        fat = struct.unpack_from(f"<{size // 4}I", d, at)
        last = max([last, *(i * (size // 4) + j for j, x in enumerate(fat) if x != 0xFFFFFFFF)])
    return (last + 2) * size


def _elf(d, o):
    if d[o + 4] not in (1, 2) or d[o + 5] not in (1, 2):
        return None
    e, wide = "<" if d[o + 5] == 1 else ">", d[o + 4] == 2
    ph, sh = struct.unpack_from(e + ("QQ" if wide else "II"), d, o + (32 if wide else 28))
    ph_size, ph_n, sh_size, sh_n = struct.unpack_from(e + "HHHH", d, o + (54 if wide else 42))
    end = max(ph + ph_size * ph_n, sh + sh_size * sh_n, 52)
    for i in range(ph_n):
        p = o + ph + i * ph_size
        if p + ph_size <= len(d):
            off, n = (struct.unpack_from(e + "Q", d, p + 8)[0], struct.unpack_from(e + "Q", d, p + 32)[0]) if wide else (struct.unpack_from(e + "I", d, p + 4)[0], struct.unpack_from(e + "I", d, p + 16)[0])
            end = max(end, off + n)
    for i in range(sh_n):
        p = o + sh + i * sh_size
        if p + sh_size <= len(d):
            kind = struct.unpack_from(e + "I", d, p + 4)[0]
            off, n = struct.unpack_from(e + ("QQ" if wide else "II"), d, p + (24 if wide else 16))
            if kind not in (0, 8):
                end = max(end, off + n)
    return end


def _pe(d, o):
    pe = o + struct.unpack_from("<I", d, o + 60)[0]
    if d[pe : pe + 4] != b"PE\0\0":
        return None
    n, opt = struct.unpack_from("<H", d, pe + 6)[0], struct.unpack_from("<H", d, pe + 20)[0]
    end = pe + 24 + opt + 40 * n - o
    for i in range(n):
        size, raw = struct.unpack_from("<II", d, pe + 24 + opt + 40 * i + 16)
        end = max(end, raw + size)
    magic = struct.unpack_from("<H", d, pe + 24)[0]
    at = pe + 24 + (144 if magic == 0x20B else 128)
    if opt >= (152 if magic == 0x20B else 136):
        off, size = struct.unpack_from("<II", d, at)
        if off:
            end = max(end, off + size)
    return end


# Signatures, types, extensions, descriptions.
KINDS = [
    (b"\x89PNG\r\n\x1a\n", "png", "png", "PNG image", _png), (b"\xff\xd8\xff", "jpeg", "jpg", "JPEG image", _jpeg), (b"GIF87a", "gif", "gif", "GIF image", _gif),
    (b"GIF89a", "gif", "gif", "GIF image", _gif), (b"RIFF", "riff", "riff", "RIFF file", _riff), (b"%PDF-", "pdf", "pdf", "PDF document", _pdf),
    (b"PK\x03\x04", "zip", "zip", "ZIP archive", _zip), (b"7z\xbc\xaf\x27\x1c", "7z", "7z", "7z archive", _sevenz), (b"Rar!\x1a\x07\x00", "rar", "rar", "RAR archive", _rar4),
    (b"Rar!\x1a\x07\x01\x00", "rar", "rar", "RAR 5 archive", _rar5), (b"MSCF\0\0\0\0", "cab", "cab", "Cabinet", _cab), (b"\x1f\x8b\x08", "gzip", "gz", "GZIP stream", _gzip),
    (b"\xfd7zXZ\0", "xz", "xz", "XZ stream", _xz), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole", "ole", "OLE compound file", _ole), (b"\x7fELF", "elf", "elf", "ELF executable", _elf),
    (b"MZ", "pe", "exe", "PE executable", _pe),
]
_ANY = re.compile(b"|".join(re.escape(k[0]) for k in sorted(KINDS, key=lambda k: -len(k[0]))))


def pieces(data: bytes, probes=()) -> list[dict]:
    """Known pieces in order, with ``unknown`` and ``padding`` between them; together they cover the data exactly."""
    out, at, seek, n = [], 0, 0, len(data)

    def gap(a, b):
        if b > a:
            kind = "padding" if not data[a:b].strip(b"\0") or not data[a:b].strip(b"\xff") else "unknown"
            out.append({"offset": a, "length": b - a, "type": kind, "extension": "bin", "description": kind, "truncated": False})

    while seek < n and (m := _ANY.search(data, seek)):
        o = m.start()
        size = kind = None
        for sign, k, ext, what, rule in KINDS:
            if data.startswith(sign, o):
                try:
                    size = rule(data, o)
                except (struct.error, IndexError):
                    size = None
                if size:
                    kind = (k, ext, what)
                    break
        if not size:
            seek = o + 1
            continue
        gap(at, o)
        end = min(o + size, n)
        out.append({"offset": o, "length": end - o, "type": kind[0], "extension": kind[1], "description": kind[2], "truncated": o + size > n})
        at = seek = end
    gap(at, n)
    return out


def carve(files: DataFrame) -> DataFrame:
    """Pieces of files given as (path, content) rows."""
    ship(files.sparkSession)
    names = schemas.PIECE.names

    def run(batches):
        for pdf in batches:
            rows = [(path, i, *(p[k] for k in names[2:])) for path, content in zip(pdf["path"], pdf["content"]) for i, p in enumerate(pieces(bytes(content or b"")))]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schemas.PIECE)


def piece_names(pieces_: DataFrame) -> DataFrame:
    """File names for the pieces that are written (padding isn't): number, offset, extension."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = F.row_number().over(Window.partitionBy("archive_path").orderBy("offset"))
    return pieces_.where("type <> 'padding'").withColumn("file_name", F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit("_0x"), F.lpad(F.hex("offset"), 8, "0"), F.lit("."), F.col("extension")))


def split_to(files: DataFrame, folder: str) -> DataFrame:
    """Write the pieces of files (but padding) below ``folder``, which all executors must share, one folder for each
    file: path, file name, bytes written."""
    ship(files.sparkSession)

    def run(batches):
        import os

        from lodestone.operators.carve import pieces

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data, n = bytes(content or b""), 0
                own = os.path.join(folder, re.sub(r"[^A-Za-z0-9._-]", "_", path.rsplit("/", 1)[-1]) + ".pieces")
                os.makedirs(own, exist_ok=True)
                for p in pieces(data):
                    if p["type"] == "padding":
                        continue
                    n += 1
                    name = f"{n:03d}_0x{p['offset']:08X}.{p['extension']}"
                    with open(os.path.join(own, name), "wb") as f:
                        f.write(data[p["offset"] : p["offset"] + p["length"]])
                    rows.append((path, name, p["length"]))
            yield pd.DataFrame(rows, columns=["archive_path", "file_name", "bytes_written"])

    return files.select("path", "content").mapInPandas(run, "archive_path string, file_name string, bytes_written long")
