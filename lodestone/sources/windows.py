"""Cabinets, OLE compound files and Windows Installer tables, compiled help, LHA, ARJ, RAR (listing, stored)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from . import lzx
from .base import ArchiveError, Bytes, Corrupted, Encrypted, Entry, Unsupported, at, dos_time, file_time


def cab(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Stored, MSZIP and LZX folders; Quantum ones are listed."""
    if data[:4] != b"MSCF":
        raise Corrupted("not a cabinet")
    b = Bytes(data, 16)
    first = at(data, 16, "<I")
    n_folders, n_files, flags = at(data, 26, "<HHH")
    b.at = 36
    folder_extra = data_extra = 0
    if flags & 4:
        header_extra, folder_extra, data_extra = b.get("<HBB")
        b.take(header_extra)
    for bit in (1, 2):
        if flags & bit:
            b.text()
            b.text()
    folders = []
    for _ in range(n_folders):
        folders.append(b.get("<IHH"))
        b.take(folder_extra)
    decoded: dict[int, bytes | ArchiveError] = {}

    def folder(i: int) -> bytes:
        start, blocks, kind = folders[i]
        if kind & 15 not in (0, 1, 3):
            raise Unsupported({2: "Quantum"}.get(kind & 15, f"method {kind}"))
        r, out, before = Bytes(data, start), [], b""
        decoder = lzx.Decoder(kind >> 8 & 31) if kind & 15 == 3 else None
        for _ in range(blocks):
            _, packed, plain = r.get("<IHH")
            r.take(data_extra)
            raw = r.take(packed)
            if decoder:
                raw = decoder.frame(raw, plain)
            elif kind & 15 == 1:
                if raw[:2] != b"CK":
                    raise Corrupted("MSZIP block without its mark")
                try:
                    d = zlib.decompressobj(-15, zdict=before) if before else zlib.decompressobj(-15)
                    raw = d.decompress(raw[2:]) + d.flush()
                except zlib.error as e:
                    raise Corrupted(f"MSZIP: {e}") from e
                if len(raw) != plain:
                    raise Corrupted("MSZIP block has another size")
                before = (before + raw)[-32768:]
            out.append(raw)
        return b"".join(out)

    r = Bytes(data, first)
    for _ in range(n_files):
        size, off, i, date, time, attr = r.get("<IIHHHH")
        raw = r.text()
        name = raw.decode("utf-8" if attr & 0x80 else "cp1252", "replace").replace("\\", "/")
        kind = folders[i][2] & 15 if i < n_folders else None
        e = Entry(name, size, modified=dos_time(date, time), method={0: "store", 1: "MSZIP", 2: "Quantum", 3: "LZX"}.get(kind))
        if want:
            if i >= n_folders:
                e.error = Unsupported("file continues in another cabinet")
            else:
                if i not in decoded:
                    decoded.clear()
                    try:
                        decoded[i] = folder(i)
                    except ArchiveError as x:
                        decoded[i] = x
                body = decoded[i]
                if isinstance(body, ArchiveError):
                    e.error = body
                elif off + size > len(body):
                    e.error = Corrupted("folder ends early")
                else:
                    e.content = body[off : off + size]
        yield e


def write_cab(files: list[tuple[str, bytes, int | None]]) -> bytes:
    """One MSZIP folder."""
    import time

    plain = b"".join(c for _, c, _ in files)
    blocks, before = [], b""
    for i in range(0, len(plain), 32768):
        part = plain[i : i + 32768]
        c = zlib.compressobj(6, zlib.DEFLATED, -15, 9, 0, before) if before else zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = b"CK" + c.compress(part) + c.flush()
        blocks.append(struct.pack("<IHH", 0, len(raw), len(part)) + raw)
        before = (before + part)[-32768:]
    table, off = b"", 0
    for name, content, mtime in files:
        t = time.gmtime(max(mtime or 0, 315_532_800))
        table += struct.pack("<IIHHHH", len(content), off, 0, (t.tm_year - 1980) << 9 | t.tm_mon << 5 | t.tm_mday, t.tm_hour << 11 | t.tm_min << 5 | t.tm_sec // 2, 0xA0) + name.replace("/", "\\").encode() + b"\0"
        off += len(content)
    start = 36 + 8 + len(table)
    size = start + sum(map(len, blocks))
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, size, 0, 44, 0, 3, 1, 1, len(files), 0, 0, 0)
    return head + struct.pack("<IHH", start, len(blocks), 1) + table + b"".join(blocks)


class Compound:
    """An OLE compound file: ``streams`` maps paths (tuples) to contents' locations."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Corrupted("not an OLE compound file")
        self.data, self.size = data, 1 << at(data, 30, "<H")
        self.small, self.cutoff = 1 << at(data, 32, "<H"), at(data, 56, "<I")
        n_fat, first_dir = at(data, 44, "<I"), at(data, 48, "<I")
        mini, _, difat, n_difat = at(data, 60, "<IIII")
        sectors = list(at(data, 76, "<109I"))
        per = self.size // 4
        for _ in range(n_difat):
            if difat >= 0xFFFFFFFA:
                break
            block = self._sector_ints(difat)
            sectors += block[: per - 1]
            difat = block[per - 1]
        self.fat: list[int] = []
        for s in sectors[:n_fat]:
            if s < 0xFFFFFFFA:
                self.fat += self._sector_ints(s)
        raw = self._chain(first_dir)
        self.entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        if not self.entries:
            raise Corrupted("OLE without a root")
        self.minifat = list(struct.unpack(f"<{len(m) // 4}I", m)) if mini < 0xFFFFFFFA and (m := self._chain(mini)) else []
        start, size = struct.unpack_from("<IQ", self.entries[0], 116)
        self.mini = self._chain(start)[:size] if start < 0xFFFFFFFA else b""

    def _sector_ints(self, s: int) -> list[int]:
        return list(struct.unpack(f"<{self.size // 4}I", Bytes(self.data, (s + 1) * self.size).take(self.size)))

    def _chain(self, s: int) -> bytes:
        out = []
        while s < 0xFFFFFFFA:
            if s >= len(self.fat) or len(out) > len(self.fat):
                raise Corrupted("OLE sector chain")
            out.append(self.data[(s + 1) * self.size : (s + 2) * self.size])
            s = self.fat[s]
        return b"".join(out)

    def content(self, e: bytes) -> bytes:
        start, size = struct.unpack_from("<IQ", e, 116)
        size &= 0xFFFFFFFF if self.size == 512 else 0xFFFFFFFFFFFFFFFF
        if size >= self.cutoff:
            out = self._chain(start)
        else:
            parts = []
            while start < 0xFFFFFFFA:
                if start >= len(self.minifat) or len(parts) > len(self.minifat):
                    raise Corrupted("OLE small sector chain")
                parts.append(self.mini[start * self.small : (start + 1) * self.small])
                start = self.minifat[start]
            out = b"".join(parts)
        if len(out) < size:
            raise Corrupted("OLE stream ends early")
        return out[:size]

    def walk(self) -> Iterator[tuple[tuple[str, ...], bytes]]:
        """Paths and directory entries of storages and streams."""

        def tree(i: int, prefix: tuple[str, ...], seen: set) -> Iterator[tuple[tuple[str, ...], bytes]]:
            stack = [i]
            while stack:
                i = stack.pop()
                if i >= len(self.entries) or i in seen:
                    continue
                seen.add(i)
                e = self.entries[i]
                n = struct.unpack_from("<H", e, 64)[0]
                name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
                left, right, child = struct.unpack_from("<III", e, 68)
                stack += [right, left]
                if e[66] in (1, 2):
                    yield (*prefix, name), e
                    if e[66] == 1:
                        yield from tree(child, (*prefix, name), seen)

        yield from tree(struct.unpack_from("<I", self.entries[0], 76)[0], (), {0})


_MSI = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"


def msi_name(name: str) -> tuple[bool, str]:
    """A stream's real name (two of 64 characters share a code point), and whether it is a table."""
    out, table = "", False
    for ch in name:
        c = ord(ch)
        if c == 0x4840:
            table = True
        elif 0x3800 <= c < 0x4800:
            out += _MSI[(c - 0x3800) & 63] + _MSI[(c - 0x3800) >> 6]
        elif 0x4800 <= c < 0x4840:
            out += _MSI[c - 0x4800]
        else:
            out += ch
    return table, out


def msi_tables(data: bytes) -> dict[str, list[dict]]:
    """All tables of an installer database, decoded from its columns; the schema comes from the _Columns table."""
    c = Compound(data)
    raw = {n: c.content(e) for path, e in c.walk() if len(path) == 1 and e[66] == 2 for t, n in [msi_name(path[0])] if t}
    pool, text = raw.get("_StringPool", b""), raw.get("_StringData", b"")
    if not pool:
        return {}
    page, high = struct.unpack_from("<HH", pool)
    wide = 3 if high & 0x8000 else 2
    codec = {0: "cp1252", 65001: "utf-8"}.get(page, f"cp{page}")
    strings, p, i = [""], 0, 4
    while i + 4 <= len(pool):
        n, refs = struct.unpack_from("<HH", pool, i)
        if n == 0 and refs:
            i += 4
            n = refs << 16 | struct.unpack_from("<H", pool, i)[0] if i + 4 <= len(pool) else 0
        strings.append(text[p : p + n].decode(codec, "replace"))
        p, i = p + n, i + 4

    def column(body: bytes, start: int, rows: int, width: int) -> list[int]:
        return [int.from_bytes(body[start + r * width : start + (r + 1) * width], "little") for r in range(rows)]

    def text_of(ids: list[int]) -> list[str | None]:
        return [strings[x] if 0 < x < len(strings) else None for x in ids]

    body = raw.get("_Columns", b"")
    rows = len(body) // (2 * wide + 4)
    names = text_of(column(body, 0, rows, wide))
    numbers = [x ^ 0x8000 for x in column(body, rows * wide, rows, 2)]
    columns = text_of(column(body, rows * (wide + 2), rows, wide))
    kinds = [x ^ 0x8000 for x in column(body, rows * (2 * wide + 2), rows, 2)]
    schema: dict[str, list] = {}
    for t, n, col, k in sorted(zip(names, numbers, columns, kinds), key=lambda x: (x[0] or "", x[1])):
        schema.setdefault(t, []).append((col, k))
    out = {}
    for t, cols in schema.items():
        body = raw.get(t, b"")
        widths = [wide if k & 0x800 else 4 if k & 0xFF == 4 else 2 for _, k in cols]
        rows = len(body) // sum(widths)
        got, start = {}, 0
        for (col, k), w in zip(cols, widths):
            v = column(body, start, rows, w)
            got[col] = text_of(v) if k & 0x800 else [None if x == 0 else x ^ (0x8000 if w == 2 else 0x80000000) for x in v]
            start += rows * w
        out[t] = [dict(zip(got, r)) for r in zip(*got.values())]
    return out


def ole(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Storages as folders and streams as files."""
    c = Compound(data)
    for path, e in c.walk():
        name = "/".join(msi_name(p)[1] for p in path)
        if e[66] == 1:
            yield Entry(name + "/", 0, modified=file_time(struct.unpack_from("<Q", e, 108)[0]), is_directory=True)
            continue
        out = Entry(name, struct.unpack_from("<I", e, 120)[0], method="store")
        if want:
            try:
                out.content = c.content(e)
            except Corrupted as x:
                out.error = x
        yield out


_CHM = "::DataSpace/Storage/MSCompressed/"


def _chm_content(stored) -> bytes:
    """The compressed section: LZX frames of 32 KB that begin anew at every reset interval."""
    control, content = stored(_CHM + "ControlData"), stored(_CHM + "Content")
    table = stored(_CHM + "Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable")
    if at(control, 4, "<4s") != b"LZXC":
        raise Unsupported("CHM compression")
    version, reset, window = at(control, 8, "<III")
    scale = 32768 if version == 2 else 1
    count, _, head, plain, _, block = at(table, 4, "<IIIQQQ")
    if block != lzx.FRAME or not reset or not window:
        raise Corrupted("CHM reset table")
    places = [*struct.unpack_from(f"<{min(count, len(content) + 1)}Q", table, head), len(content)]
    out, decoder = [], None
    for i in range(-(-plain // block)):
        if i % max(1, reset * scale // block) == 0:
            decoder = lzx.Decoder((window * scale).bit_length() - 1)
        out.append(decoder.frame(content[places[i] : places[i + 1]], min(block, plain - i * block)))
    return b"".join(out)


def chm(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Files of a help file, in its stored and its LZX section."""
    if data[:4] != b"ITSF":
        raise Corrupted("not a CHM file")
    dir_at, _, base = at(data, 72, "<QQQ") if at(data, 4, "<I") >= 3 else (*at(data, 72, "<QQ"), 0)
    if data[dir_at : dir_at + 4] != b"ITSP":
        raise Corrupted("CHM without a directory")
    head, size = at(data, dir_at + 8, "<I"), at(data, dir_at + 16, "<I")
    chunk = at(data, dir_at + 32, "<i")
    base = base or dir_at + head + size * at(data, dir_at + 44, "<I")

    def number(b: Bytes) -> int:
        v = 0
        while True:
            x = b.u8()
            v = v << 7 | x & 0x7F
            if x < 0x80:
                return v

    found: dict[str, tuple[int, int, int]] = {}
    seen = set()
    while chunk >= 0 and chunk not in seen:
        seen.add(chunk)
        raw = Bytes(data, dir_at + head + chunk * size).take(size)
        if raw[:4] != b"PMGL":
            raise Corrupted("CHM directory chunk")
        free, _, _, chunk = struct.unpack_from("<IIii", raw, 4)
        b = Bytes(raw[: size - free], 20)
        while b.at < len(b.data):
            name = b.take(number(b)).decode("utf-8", "replace")
            found[name] = number(b), number(b), number(b)

    def stored(name: str) -> bytes:
        if name not in found:
            raise Corrupted(f"CHM without {name}")
        return Bytes(data, base + found[name][1]).take(found[name][2])

    packed: bytes | ArchiveError | None = None
    for name, (section, off, n) in found.items():
        if not name.startswith("/") or name == "/" or name[1:2] in ("#", "$"):
            continue
        e = Entry(name[1:], 0 if name.endswith("/") else n, is_directory=name.endswith("/"), method="LZX" if section else "store")
        if want and not e.is_directory:
            try:
                if section == 0:
                    e.content = Bytes(data, base + off).take(n)
                else:
                    if packed is None:
                        try:
                            packed = _chm_content(stored)
                        except ArchiveError as x:
                            packed = x
                    if isinstance(packed, ArchiveError):
                        raise packed
                    e.content = Bytes(packed, off).take(n)
            except ArchiveError as x:
                e.error = x
        yield e


class _Bits:
    """Bits from the top of each byte."""

    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.bits = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            self.bits = self.bits << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.have += 8
        return self.bits >> (self.have - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.peek(n)
        self.have -= n
        self.bits &= (1 << self.have) - 1

    def get(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.skip(n)
        return v


def _codes(lengths: list[int]) -> tuple[dict, int]:
    """Canonical prefix codes: (length, code) to symbol."""
    out, code, most = {}, 0, max(lengths, default=0)
    for n in range(1, most + 1):
        for s, x in enumerate(lengths):
            if x == n:
                out[n, code] = s
                code += 1
        code <<= 1
    return out, most


def _symbol(b: _Bits, codes: tuple[dict, int], single: int | None) -> int:
    if single is not None:
        return single
    table, most = codes
    for n in range(1, most + 1):
        s = table.get((n, b.peek(n)))
        if s is not None:
            b.skip(n)
            return s
    raise Corrupted("prefix code")


def lzh(raw: bytes, size: int, window: int) -> bytes:
    """LZSS with blocks of prefix codes (lh4 to lh7, ARJ methods 1 to 3)."""
    b, out = _Bits(raw), bytearray()
    n_dist, dist_bits = (15, 4) if window <= 14 else (window + 1, 5)
    n_dist = max(n_dist, window + 1)

    def lengths(count: int, width: int, gap: int) -> tuple[list[int], int | None]:
        n = b.get(width)
        if n == 0:
            return [], b.get(width)
        got: list[int] = []
        while len(got) < n:
            x = b.get(3)
            if x == 7:
                while b.get(1):
                    x += 1
            got.append(x)
            if len(got) == gap:
                got += [0] * b.get(2)
        return got[: max(count, n)], None

    while len(out) < size:
        if b.at > len(raw) + 8:
            raise Corrupted("data ends early")
        block = b.get(16)
        pre, pre_one = lengths(19, 5, 3)
        pre_codes = _codes(pre)
        n = b.get(9)
        if n == 0:
            lit, lit_one = [], b.get(9)
        else:
            lit, lit_one = [], None
            while len(lit) < n:
                s = _symbol(b, pre_codes, pre_one)
                lit += [0] * (1 if s == 0 else b.get(4) + 3 if s == 1 else b.get(9) + 20) if s <= 2 else [s - 2]
        lit_codes = _codes(lit)
        dist, dist_one = lengths(n_dist, dist_bits, -1)
        dist_codes = _codes(dist)
        for _ in range(block):
            if len(out) >= size:
                break
            s = _symbol(b, lit_codes, lit_one)
            if s < 256:
                out.append(s)
                continue
            d = _symbol(b, dist_codes, dist_one)
            d = d if d <= 1 else (1 << (d - 1)) + b.get(d - 1)
            for _ in range(s - 253):
                out.append(out[-d - 1] if d < len(out) else 32)
    return bytes(out[:size])


def _crc16(data: bytes) -> int:
    c = 0
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0xA001 if c & 1 else 0)
    return c


def lha(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Headers of levels 0 to 2; lh0, lz4 and lh4 to lh7 are decoded, the others listed."""
    p = 0
    while p + 21 < len(data) and data[p]:
        level, method = data[p + 20], data[p + 2 : p + 7].decode("latin-1")
        if method[0] != "-" or method[4] != "-":
            raise Corrupted("LHA header")
        packed, plain, stamp = at(data, p + 7, "<III")
        name, folder, modified = b"", b"", None
        if level < 2:
            n = data[p + 21]
            name = Bytes(data, p + 22).take(n)
            crc = at(data, p + 22 + n, "<H")
            modified = dos_time(stamp >> 16, stamp & 0xFFFF)
            body = p + 2 + data[p]
            ext = at(data, body - 2, "<H") if level == 1 else 0
        else:
            modified, crc = stamp, at(data, p + 21, "<H")
            body, ext = p + at(data, p, "<H"), at(data, p + 24, "<H")
        q = body if level == 1 else p + 26
        while ext:
            x = Bytes(data, q).take(ext)
            if x[0] == 1:
                name = x[1:-2]
            elif x[0] == 2:
                folder = x[1:-2].replace(b"\xff", b"/")
            if level == 1:
                packed, body = packed - ext, body + ext
            q += ext
            ext = struct.unpack("<H", x[-2:])[0]
        full = (folder + name).decode("utf-8", "replace").replace("\\", "/")
        is_dir = method == "-lhd-"
        e = Entry(full.rstrip("/") + "/" * is_dir, plain, packed, modified, is_dir, method=method.strip("-"))
        raw = Bytes(data, body).take(packed)
        if want and not is_dir:
            try:
                if method in ("-lh0-", "-lz4-"):
                    e.content = raw
                elif method in ("-lh4-", "-lh5-", "-lh6-", "-lh7-"):
                    e.content = lzh(raw, plain, {"4": 12, "5": 13, "6": 15, "7": 16}[method[3]])
                else:
                    raise Unsupported(method)
                if _crc16(e.content) != crc:
                    e.content = None
                    raise Corrupted("CRC doesn't fit")
            except (ArchiveError, IndexError) as x:
                e.error = x if isinstance(x, ArchiveError) else Corrupted("LHA data")
        yield e
        p = body + packed


def arj(data: bytes, want: bool = True, password: str | None = None, **_) -> Iterator[Entry]:
    """Methods 0 to 3; garbled files need the password."""
    p, first = 0, True
    while True:
        if data[p : p + 2] != b"\x60\xea":
            raise Corrupted("ARJ header")
        n = at(data, p + 2, "<H")
        if n == 0:
            return
        h = Bytes(data, p + 4).take(n)
        if zlib.crc32(h) != at(data, p + 4 + n, "<I"):
            raise Corrupted("ARJ header CRC doesn't fit")
        q = p + 8 + n
        while (x := at(data, q, "<H")) != 0:
            q += 2 + x + 4
        q += 2
        name, comment = h[h[0] :].split(b"\0")[:2]
        if first:
            first, p = False, q
            continue
        flags, method, kind, modifier = h[4], h[5], h[6], h[7]
        stamp, packed, plain, crc = struct.unpack_from("<IIII", h, 8)
        mode = struct.unpack_from("<H", h, 26)[0]
        is_dir = kind == 3
        e = Entry(name.decode("utf-8", "replace").replace("\\", "/").rstrip("/") + "/" * is_dir, plain, packed, dos_time(stamp >> 16, stamp & 0xFFFF), is_dir, bool(flags & 1), crc, f"method {method}", mode & 0o7777 if h[3] == 2 else None, comment=comment.decode("utf-8", "replace") or None)
        raw = Bytes(data, q).take(packed)
        if want and not is_dir:
            try:
                if flags & 1:
                    if not password:
                        raise Encrypted("a password is needed")
                    key = password.encode()
                    raw = bytes(c ^ (modifier + key[i % len(key)] & 0xFF) for i, c in enumerate(raw))
                if method == 0:
                    e.content = raw
                elif method in (1, 2, 3):
                    e.content = lzh(raw, plain, 16)
                else:
                    raise Unsupported(f"method {method}")
                if zlib.crc32(e.content) != crc:
                    e.content = None
                    raise Encrypted("wrong password") if flags & 1 else Corrupted("CRC doesn't fit")
            except (ArchiveError, IndexError) as x:
                e.error = x if isinstance(x, ArchiveError) else Corrupted("ARJ data")
        yield e
        p = q + packed


def rar(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """RAR 4 and 5: all entries are listed, stored ones have content."""
    if data[:8] == b"Rar!\x1a\x07\x01\0":
        yield from _rar5(data, want)
    elif data[:7] == b"Rar!\x1a\x07\0":
        yield from _rar4(data, want)
    else:
        raise Corrupted("not a RAR archive")


def _stored(e: Entry, raw: bytes, stored: bool, want: bool) -> Entry:
    if want and not e.is_directory and e.link_target is None:
        if e.is_encrypted:
            e.error = Encrypted("a password is needed")
        elif not stored:
            e.error = Unsupported("RAR compression")
        elif e.crc32 is not None and zlib.crc32(raw) != e.crc32:
            e.error = Corrupted("CRC doesn't fit")
        else:
            e.content = raw
    return e


def _rar5(data: bytes, want: bool) -> Iterator[Entry]:
    b = Bytes(data, 8)

    def vint(r: Bytes) -> int:
        v = shift = 0
        while True:
            x = r.u8()
            v |= (x & 0x7F) << shift
            shift += 7
            if x < 0x80 or shift > 63:
                return v

    while b.at < len(data):
        crc = b.get("<I")
        start = b.at
        size = vint(b)
        h = Bytes(b.take(size))
        if zlib.crc32(data[start : b.at]) != crc:
            raise Corrupted("RAR header CRC doesn't fit")
        kind, flags = vint(h), vint(h)
        extra = vint(h) if flags & 1 else 0
        body = vint(h) if flags & 2 else 0
        if kind == 4:
            raise Encrypted("encrypted headers")
        if kind == 5:
            return
        raw = b.take(body)
        if kind != 2:
            continue
        ff, plain, attr = vint(h), vint(h), vint(h)
        mtime = h.get("<I") if ff & 2 else None
        crc32 = h.get("<I") if ff & 4 else None
        method, host = vint(h), vint(h)
        name = h.take(vint(h)).decode("utf-8", "replace")
        is_dir, encrypted, link = bool(ff & 1), False, None
        x = Bytes(h.data[len(h.data) - extra :]) if extra else Bytes(b"")
        while x.at < len(x.data):
            n = vint(x)
            r = Bytes(x.take(n))
            t = vint(r)
            if t == 1:
                encrypted = True
            elif t == 3:
                tf = vint(r)
                if tf & 2:
                    mtime = r.get("<I") if tf & 1 else file_time(r.get("<Q"))
            elif t == 5:
                vint(r), vint(r)
                link = r.take(vint(r)).decode("utf-8", "replace")
        level = method >> 7 & 7
        yield _stored(Entry(name + "/" * is_dir, plain, body, mtime, is_dir, encrypted, crc32, "store" if level == 0 else f"RAR5 m{level}", attr & 0o7777 if host == 1 else None, link), raw, level == 0, want)


def _rar4(data: bytes, want: bool) -> Iterator[Entry]:
    b = Bytes(data, 7)
    while b.at + 7 <= len(data):
        start = b.at
        crc, kind, flags, size = b.get("<HBHH")
        if size < 7:
            raise Corrupted("RAR header size")
        b.at = start
        h = b.take(size)
        if kind == 0x73 and flags & 0x80:
            raise Encrypted("encrypted headers")
        if kind == 0x7B:
            return
        extra = struct.unpack_from("<I", h, 7)[0] if flags & 0x8000 and size >= 11 else 0
        if kind != 0x74:
            b.take(extra)
            continue
        if zlib.crc32(h[2:]) & 0xFFFF != crc:
            raise Corrupted("RAR header CRC doesn't fit")
        packed, plain, host, crc32, stamp, _, method, n, attr = struct.unpack_from("<IIBIIBBHI", h, 7)
        p = 32
        if flags & 0x100:
            hi_packed, hi_plain = struct.unpack_from("<II", h, p)
            packed, plain, p = packed | hi_packed << 32, plain | hi_plain << 32, p + 8
        name = h[p : p + n]
        name = _rar4_name(name) if flags & 0x200 and b"\0" in name else name.decode("utf-8", "replace")
        is_dir = flags & 0xE0 == 0xE0
        raw = b.take(packed)
        e = Entry(name.replace("\\", "/") + "/" * is_dir, plain, packed, dos_time(stamp >> 16, stamp & 0xFFFF), is_dir, bool(flags & 4), crc32, "store" if method == 0x30 else f"RAR4 m{method - 0x30}", attr & 0o7777 if host == 3 else None)
        yield _stored(e, raw, method == 0x30, want)


def _rar4_name(raw: bytes) -> str:
    """A name stored twice: in bytes, and as differences to them in code units."""
    plain, _, enc = raw.partition(b"\0")
    if not enc:
        return plain.decode("utf-8", "replace")
    high, p, flags, left, out = enc[0], 1, 0, 0, []
    while p < len(enc):
        if left == 0:
            flags, left, p = enc[p], 8, p + 1
            if p >= len(enc):
                break
        left -= 2
        k = flags >> left & 3
        if k == 0:
            out.append(enc[p])
            p += 1
        elif k == 1:
            out.append(enc[p] | high << 8)
            p += 1
        elif k == 2 and p + 1 < len(enc):
            out.append(enc[p] | enc[p + 1] << 8)
            p += 2
        else:
            n = enc[p]
            p += 1
            add = 0
            if n & 0x80 and p < len(enc):
                add, p = enc[p], p + 1
                out += [(c + add & 0xFF) | high << 8 for c in plain[len(out) : len(out) + (n & 0x7F) + 2]]
            else:
                out += plain[len(out) : len(out) + (n & 0x7F) + 2]
    return "".join(map(chr, out))
