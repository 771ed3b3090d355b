"""Disk and file system images: ISO 9660, SquashFS, AmigaDOS floppies, WIM, UDIF (DMG)."""

from __future__ import annotations

import bz2
import lzma
import plistlib
import struct
import zlib
from collections.abc import Iterator

from . import lzx
from .base import ArchiveError, Bytes, Corrupted, Encrypted, Entry, Unsupported, at, file_time

MAX_DEPTH, MAX_DIRECTORY = 256, 64 << 20


def _iso_time(raw: bytes) -> int | None:
    import calendar

    if len(raw) < 7 or not raw[1]:
        return None
    try:
        return calendar.timegm((1900 + raw[0], raw[1], raw[2], raw[3], raw[4], raw[5])) - 900 * int.from_bytes(raw[6:7], "little", signed=True)
    except ValueError:
        return None


def _rock_ridge(data: bytes, area: bytes, out: dict, depth: int = 0) -> dict:
    """System use entries: names, modes, links, relocated directories, continued areas."""
    p = 0
    while p + 4 <= len(area):
        kind, n = area[p : p + 2], area[p + 2]
        if n < 4 or p + n > len(area):
            break
        body = area[p + 4 : p + n]
        if kind == b"NM" and body:
            out["name"] = out.get("name", b"") + (b"" if body[0] & 6 else body[1:])
        elif kind == b"PX" and len(body) >= 4:
            out["mode"] = struct.unpack_from("<I", body)[0]
        elif kind == b"CL" and len(body) >= 4:
            out["child"] = struct.unpack_from("<I", body)[0]
        elif kind == b"ZF" and len(body) >= 8:
            out["packed"] = body[:2], struct.unpack_from("<I", body, 4)[0]
        elif kind == b"RE":
            out["moved"] = True
        elif kind == b"SL" and body:
            q, parts = 1, out.setdefault("link", [])
            while q + 2 <= len(body):
                flag, m = body[q], body[q + 1]
                text = {2: b".", 4: b"..", 8: b""}.get(flag & 14, body[q + 2 : q + 2 + m])
                if out.pop("joined", False):
                    parts[-1] += text
                else:
                    parts.append(text)
                if flag & 1:
                    out["joined"] = True
                q += 2 + m
        elif kind == b"CE" and len(body) >= 24 and depth < 32:
            block, _, off, _, size, _ = struct.unpack("<I4sI4sI4s", body[:24])
            _rock_ridge(data, data[block * 2048 + off : block * 2048 + off + size], out, depth + 1)
        elif kind == b"ST":
            break
        p += n
    return out


def _zisofs(raw: bytes, size: int) -> bytes:
    """A zisofs file: a header, pointers to its blocks, each a zlib stream or, where it is empty, zeros."""
    if len(raw) < 16 or raw[:8] != b"\x37\xe4\x53\x96\xc9\xdb\xd6\x07":
        raise Corrupted("no zisofs header")
    said, head, log = struct.unpack_from("<IBB", raw, 8)
    if said != size or not 15 <= log <= 17:
        raise Corrupted("bad zisofs header")
    block, n = 1 << log, (size + (1 << log) - 1) >> log
    if 4 * head + 4 * (n + 1) > len(raw):
        raise Corrupted("zisofs pointers end early")
    at = struct.unpack_from(f"<{n + 1}I", raw, 4 * head)
    out = []
    for i, (a, b) in enumerate(zip(at, at[1:])):
        want = min(block, size - i * block)
        if not a <= b <= len(raw):
            raise Corrupted("bad zisofs pointer")
        if a == b:
            out.append(bytes(want))
            continue
        d = zlib.decompressobj()
        try:
            got = d.decompress(raw[a:b], want + 1)
            # the checksum may still follow the last byte
            got += d.decompress(d.unconsumed_tail, 1) if not d.eof and len(got) == want else b""
        except zlib.error as x:
            raise Corrupted(f"zisofs block {i}: {x}") from x
        if len(got) != want or not d.eof:
            raise Corrupted(f"zisofs block {i} has another size")
        out.append(got)
    return b"".join(out)


def iso(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """ISO 9660 with Joliet or Rock Ridge names; files of several extents are joined, zisofs files are inflated."""
    primary = joliet = None
    for sector in range(16, 64):
        d = data[sector * 2048 : sector * 2048 + 2048]
        if len(d) < 2048 or d[1:6] != b"CD001":
            break
        if d[0] == 255:
            break
        if d[0] == 1:
            primary = d
        elif d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
    if primary is None:
        raise Corrupted("no ISO 9660 volume descriptor")

    def records(extent: int, size: int):
        if size > MAX_DIRECTORY:
            raise Corrupted("ISO directory is too large")
        raw = Bytes(data, extent * 2048).take(size)
        p = 0
        while p < size:
            n = raw[p]
            if n == 0:
                p = (p // 2048 + 1) * 2048
                continue
            if n < 34 or p + n > size:
                raise Corrupted("bad ISO directory record")
            yield raw[p : p + n]
            p += n

    root = primary[156:190]
    first = next(records(*struct.unpack_from("<I4xI", root, 2)), b"")
    has_names = b"SP" in first[34:] or any(b"RR" in r[33:] or b"NM" in r[33:] for _, r in zip(range(8), records(*struct.unpack_from("<I4xI", root, 2))))
    if not has_names and joliet is not None:
        root = joliet[156:190]
    wide = not has_names and joliet is not None

    def walk(extent: int, size: int, prefix: str, depth: int, seen: frozenset) -> Iterator[Entry]:
        if depth > MAX_DEPTH:
            raise Corrupted("ISO directories are too deep")
        pending = b""
        for r in records(extent, size):
            n = r[32]
            raw = r[33 : 33 + n]
            if raw in (b"\0", b"\1"):
                continue
            rr = _rock_ridge(data, r[33 + n + (1 - n % 2) :], {}) if has_names else {}
            if rr.get("moved"):
                continue
            name = rr["name"].decode("utf-8", "replace") if rr.get("name") else raw.decode("utf-16-be", "replace") if wide else raw.decode("latin-1")
            if not rr.get("name"):
                name = name.split(";")[0]
                name = name[:-1] if name.endswith(".") and not wide else name
            start, length = struct.unpack_from("<I4xI", r, 2)
            mode, when = rr.get("mode"), _iso_time(r[18:25])
            if r[25] & 2 or "child" in rr:
                if "child" in rr:
                    start = rr["child"]
                    length = struct.unpack_from("<I", next(records(start, 2048)), 10)[0]
                yield Entry(f"{prefix}{name}/", 0, modified=when, is_directory=True, mode=mode & 0o7777 if mode else None)
                if start not in seen:
                    yield from walk(start, length, f"{prefix}{name}/", depth + 1, seen | {start})
                continue
            if r[25] & 0x80:
                pending += Bytes(data, start * 2048).take(length)
                continue
            link = "/".join(p.decode("utf-8", "replace") for p in rr["link"]) if "link" in rr else None
            e = Entry(prefix + name, len(pending) + length, modified=when, method="store", mode=mode & 0o7777 if mode else None, link_target=link)
            how, size = rr.get("packed", (None, 0))
            if how == b"pz":
                e.uncompressed_size, e.compressed_size, e.method = size, len(pending) + length, "zisofs"
            if how == b"pz" and size >= 1 << 31:
                e.error = Unsupported("zisofs file over 2 GB")
            elif how and how != b"pz":
                e.error = Unsupported(f"ISO compression {how.decode('latin-1')}")
            if want and link is None and e.error is None:
                try:
                    e.content = pending + Bytes(data, start * 2048).take(length)
                    if how:
                        e.content = _zisofs(e.content, size)
                except Corrupted as x:
                    e.content, e.error = None, x
            pending = b""
            yield e

    extent, size = struct.unpack_from("<I4xI", root, 2)
    yield from walk(extent, size, "", 0, frozenset({extent}))


def squashfs(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """SquashFS 4.0 with gzip, LZMA, LZO, XZ, LZ4 or Zstandard blocks."""
    from ..functions.codecs import decompress, lzo1x

    (magic, _, _, block, n_frag, comp, _, _, n_ids, major, _, root, _, _, _, inode_at, dir_at, frag_at, _) = Bytes(data).get("<IIIIIHHHHHHQQQQQQQQ")
    if magic != 0x73717368 or major != 4:
        raise Corrupted("not SquashFS 4")

    def unpack(raw: bytes, size: int) -> bytes:
        try:
            if comp == 1:
                return zlib.decompress(raw)
            if comp == 2:
                return lzma.decompress(raw, lzma.FORMAT_ALONE)
            if comp == 3:
                return lzo1x(raw, size)
            if comp == 4:
                return lzma.decompress(raw)
            if comp == 5:
                import pyarrow as pa

                return pa.Codec("lz4_raw").decompress(raw, size, asbytes=True)
            if comp == 6:
                return decompress("ZSTD", raw)
        except (zlib.error, lzma.LZMAError, OSError, ValueError) as e:
            raise Corrupted(f"SquashFS block: {e}") from e
        raise Unsupported(f"SquashFS compression {comp}")

    cache: dict[int, tuple[bytes, int]] = {}

    def meta(pos: int) -> tuple[bytes, int]:
        if pos not in cache:
            h = at(data, pos, "<H")
            n = h & 0x7FFF
            raw = Bytes(data, pos + 2).take(n)
            cache[pos] = raw if h & 0x8000 else unpack(raw, 8192), pos + 2 + n
        return cache[pos]

    class Meta:
        def __init__(self, base: int, ref: int):
            self.pos, self.off = base + (ref >> 16), ref & 0xFFFF

        def take(self, n: int) -> bytes:
            out = b""
            while n:
                raw, after = meta(self.pos)
                part = raw[self.off : self.off + n]
                out, n, self.off = out + part, n - len(part), self.off + len(part)
                if self.off >= len(raw):
                    self.pos, self.off = after, 0
                elif not part:
                    raise Corrupted("SquashFS metadata ends early")
            return out

        def get(self, fmt: str):
            return struct.unpack(fmt, self.take(struct.calcsize(fmt)))

    def fragment(i: int) -> bytes:
        table = at(data, frag_at + i // 512 * 8, "<Q")
        start, size, _ = struct.unpack_from("<QII", meta(table)[0], i % 512 * 16)
        raw = Bytes(data, start).take(size & 0xFFFFFF)
        return raw if size & 0x1000000 else unpack(raw, block)

    def inode(ref: int) -> dict:
        m = Meta(inode_at, ref)
        kind, mode, _, _, mtime, _ = m.get("<HHHHII")
        out = {"kind": kind, "mode": mode, "mtime": mtime}
        if kind == 1:
            start, _, size, off, _ = m.get("<IIHHI")
            out |= {"dir": (start, off), "size": size}
        elif kind == 8:
            _, size, start, _, _, off, _ = m.get("<IIIIHHI")
            out |= {"dir": (start, off), "size": size}
        elif kind in (2, 9):
            if kind == 2:
                start, frag, off, size = m.get("<IIII")
            else:
                start, size, _, _, frag, off, _ = m.get("<QQQIIII")
            n = size // block if frag != 0xFFFFFFFF else -(-size // block)
            if n * 4 > len(data) + (1 << 20):
                raise Corrupted("SquashFS file size")
            out |= {"start": start, "size": size, "frag": frag, "off": off, "blocks": m.get(f"<{n}I") if n else ()}
        elif kind in (3, 10):
            _, n = m.get("<II")
            out["link"] = m.take(n).decode("utf-8", "replace")
        return out

    def content(x: dict) -> bytes:
        out, pos = [], x["start"]
        left = x["size"]
        for b in x["blocks"]:
            n = b & 0xFFFFFF
            want_n = min(block, left)
            raw = Bytes(data, pos).take(n)
            out.append(b"\0" * want_n if n == 0 else raw if b & 0x1000000 else unpack(raw, want_n))
            pos, left = pos + n, left - want_n
        if x["frag"] != 0xFFFFFFFF:
            out.append(fragment(x["frag"])[x["off"] : x["off"] + left])
        got = b"".join(out)
        if len(got) != x["size"]:
            raise Corrupted("SquashFS file has another size")
        return got

    def walk(ref: int, prefix: str, depth: int) -> Iterator[Entry]:
        if depth > MAX_DEPTH:
            raise Corrupted("SquashFS directories are too deep")
        d = inode(ref)
        left = d["size"] - 3
        m = Meta(dir_at, d["dir"][0] << 16 | d["dir"][1])
        while left > 0:
            count, start, _ = m.get("<III")
            left -= 12
            for _ in range(count + 1):
                off, _, _, n = m.get("<HhHH")
                name = m.take(n + 1).decode("utf-8", "replace")
                left -= 9 + n
                child = start << 16 | off
                x = inode(child)
                if x["kind"] in (1, 8):
                    yield Entry(f"{prefix}{name}/", 0, modified=x["mtime"], is_directory=True, mode=x["mode"])
                    yield from walk(child, f"{prefix}{name}/", depth + 1)
                    continue
                e = Entry(prefix + name, x.get("size", 0), modified=x["mtime"], mode=x["mode"], link_target=x.get("link"))
                if want and "blocks" in x:
                    try:
                        e.content = content(x)
                    except ArchiveError as err:
                        e.error = err
                yield e

    yield from walk(root, "", 0)


def adf(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """AmigaDOS floppies: old and fast file system."""
    if len(data) not in (901120, 1802240) or data[:3] != b"DOS":
        raise Corrupted("not an AmigaDOS floppy")
    fast, root = data[3] & 1, len(data) // 1024

    def long(block: int, off: int) -> int:
        if not 0 < block < len(data) // 512:
            raise Corrupted("block out of range")
        return at(data, block * 512 + off, ">I")

    def when(block: int) -> int:
        days, minutes, ticks = at(data, block * 512 + 420, ">III")
        return 252_460_800 + days * 86_400 + minutes * 60 + ticks // 50

    def name(block: int) -> str:
        n = data[block * 512 + 432]
        return data[block * 512 + 433 : block * 512 + 433 + min(n, 30)].decode("latin-1")

    def content(block: int, size: int) -> bytes:
        out, header = [], block
        while header:
            for i in range(min(long(header, 8), 72)):
                b = long(header, 308 - 4 * i)
                if not 0 < b < len(data) // 512:
                    raise Corrupted("data block out of range")
                raw = data[b * 512 : b * 512 + 512]
                out.append(raw if fast else raw[24 : 24 + struct.unpack_from(">I", raw, 12)[0]])
            header = long(header, 504)
            if len(out) * 512 > len(data):
                raise Corrupted("file blocks form a loop")
        got = b"".join(out)[:size]
        if len(got) < size:
            raise Corrupted("file ends early")
        return got

    def walk(block: int, prefix: str, seen: set) -> Iterator[Entry]:
        for i in range(72):
            b = long(block, 24 + 4 * i)
            while b:
                if b in seen:
                    raise Corrupted("directory blocks form a loop")
                seen.add(b)
                kind = at(data, b * 512 + 508, ">i")
                if kind == 2:
                    yield Entry(f"{prefix}{name(b)}/", 0, modified=when(b), is_directory=True)
                    yield from walk(b, f"{prefix}{name(b)}/", seen)
                elif kind == -3:
                    e = Entry(prefix + name(b), long(b, 324), modified=when(b), method="store")
                    if want:
                        try:
                            e.content = content(b, e.uncompressed_size)
                        except Corrupted as x:
                            e.error = x
                    yield e
                b = long(b, 496)

    yield from walk(root, "", set())


def xpress(raw: bytes, size: int) -> bytes:
    """XPRESS with Huffman codes, as WIM chunks use it: 256 bytes of code lengths, then 16-bit words."""
    lengths = [x for b in raw[:256] for x in (b & 15, b >> 4)]
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    table, code = [None] * 32768, 0
    for n, s in order:
        width = 1 << (15 - n)
        if code + width > 32768:
            raise Corrupted("XPRESS code lengths")
        table[code : code + width] = [(s, n)] * width
        code += width
    p, bits, have, out = 256, 0, 0, bytearray()

    def fill():
        nonlocal bits, have, p
        while have <= 16:
            bits = bits << 16 | (struct.unpack_from("<H", raw, p)[0] if p + 2 <= len(raw) else 0)
            p += 2
            have += 16

    while len(out) < size:
        fill()
        got = table[bits >> (have - 15) & 0x7FFF]
        if got is None or p > len(raw) + 8:
            raise Corrupted("XPRESS data")
        s, n = got
        have -= n
        bits &= (1 << have) - 1
        if s < 256:
            out.append(s)
            continue
        n, width = s & 15, s >> 4 & 15
        if n == 15:
            n += raw[p] if p < len(raw) else 0
            p += 1
            if n == 270:
                n = struct.unpack_from("<H", raw, p)[0]
                p += 2
        fill()
        have -= width
        dist = (1 << width) + (bits >> have)
        bits &= (1 << have) - 1
        if dist > len(out):
            raise Corrupted("XPRESS distance")
        for _ in range(n + 3):
            out.append(out[-dist])
    return bytes(out[:size])


def wim(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """WIM images, stored, XPRESS or LZX; with several images, each is a folder."""
    b = Bytes(data)
    if b.take(8) != b"MSWIM\0\0\0":
        raise Corrupted("not a WIM file")
    _, _, flags, chunk = b.get("<IIII")
    b.take(16)
    _, _, images = b.get("<HHI")

    def resource() -> tuple[int, int, int, int]:
        x, start, plain = b.get("<QQQ")
        return x & 0xFFFFFFFFFFFFFF, x >> 56, start, plain

    table = resource()

    def load(r: tuple[int, int, int, int]) -> bytes:
        size, flag, start, plain = r
        raw = Bytes(data, start).take(size)
        if not flag & 4:
            return raw
        if flag & 0x10:
            raise Unsupported("solid WIM")
        if not flags & 0x60000:
            raise Unsupported("WIM compression")
        unpack = xpress if flags & 0x20000 else lambda part, size: lzx.Decoder(15, chunk=True).frame(part, size)
        n = -(-plain // chunk)
        width = 8 if plain > 0xFFFFFFFF else 4
        offs = [0, *struct.unpack_from(f"<{n - 1}{'Q' if width == 8 else 'I'}", raw)] if n else []
        body, out = raw[width * (n - 1) :], []
        for i, o in enumerate(offs):
            part = body[o : offs[i + 1] if i + 1 < n else len(body)]
            want_n = min(chunk, plain - i * chunk)
            out.append(part if len(part) == want_n else unpack(part, want_n))
        return b"".join(out)

    files, metadata = {}, []
    t = Bytes(load(table))
    while t.at + 50 <= len(t.data):
        x, start, plain = t.get("<QQQ")
        _, _, digest = t.get("<HI20s")
        r = x & 0xFFFFFFFFFFFFFF, x >> 56, start, plain
        if r[1] & 2:
            metadata.append(r)
        else:
            files[digest] = r

    def walk(m: bytes, pos: int, prefix: str, depth: int) -> Iterator[Entry]:
        if depth > MAX_DEPTH:
            raise Corrupted("WIM directories are too deep")
        while True:
            n = at(m, pos, "<Q")
            if n <= 8:
                return
            attr, _, sub = struct.unpack_from("<IiQ", m, pos + 8)
            written, digest = struct.unpack_from("<Q", m, pos + 56)[0], m[pos + 64 : pos + 84]
            streams, _, name_n = struct.unpack_from("<HHH", m, pos + 96)
            name = m[pos + 102 : pos + 102 + name_n].decode("utf-16-le", "replace")
            if attr & 0x10:
                if name:
                    yield Entry(f"{prefix}{name}/", 0, modified=file_time(written), is_directory=True)
                yield from walk(m, sub, f"{prefix}{name}/" if name else prefix, depth + 1)
            else:
                q = pos + n
                for _ in range(streams):
                    k = at(m, q, "<Q")
                    if struct.unpack_from("<H", m, q + 36)[0] == 0:
                        digest = m[q + 16 : q + 36]
                    q += k
                r = files.get(digest)
                e = Entry(prefix + name, r[3] if r else 0, r[0] if r else 0, file_time(written), method=("XPRESS" if flags & 0x20000 else "LZX") if r and r[1] & 4 else "store")
                if want:
                    try:
                        e.content = load(r) if r else b""
                    except ArchiveError as x:
                        e.error = x
                yield e
            pos += n
            for _ in range(streams):
                pos += at(m, pos, "<Q")

    for i, r in enumerate(metadata):
        m = load(r)
        security = max(8, at(m, 0, "<I"))
        yield from walk(m, -(-security // 8) * 8, f"{i + 1}/" if images > 1 else "", 0)


def _adc(raw: bytes) -> bytes:
    out, p = bytearray(), 0
    while p < len(raw):
        c = raw[p]
        if c & 0x80:
            n = (c & 0x7F) + 1
            out += raw[p + 1 : p + 1 + n]
            p += 1 + n
            continue
        if c & 0x40:
            n, dist = (c & 0x3F) + 4, raw[p + 1] << 8 | raw[p + 2]
            p += 3
        else:
            n, dist = (c >> 2 & 15) + 3, (c & 3) << 8 | raw[p + 1]
            p += 2
        for _ in range(n):
            out.append(out[-dist - 1])
    return bytes(out)


def dmg(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """UDIF images: each partition as a raw image."""
    if data[:8] == b"encrcdsa":
        raise Encrypted("encrypted disk image")
    k = data[-512:]
    if k[:4] != b"koly":
        raise Unsupported("no UDIF trailer")
    xml_at, xml_n = struct.unpack_from(">QQ", k, 216)
    fork = struct.unpack_from(">Q", k, 24)[0]
    try:
        plist = plistlib.loads(Bytes(data, xml_at).take(xml_n))
        tables = plist["resource-fork"]["blkx"]
    except (plistlib.InvalidFileException, KeyError, ValueError, Corrupted) as e:
        raise Corrupted(f"DMG property list: {e}") from e
    for i, t in enumerate(tables):
        raw = bytes(t["Data"])
        sectors = struct.unpack_from(">Q", raw, 16)[0]
        n = struct.unpack_from(">I", raw, 200)[0]
        label = (t.get("Name") or t.get("CFName") or f"partition {i}").split(" (")[0].strip().replace("/", "_") or f"partition {i}"
        e = Entry(f"{i}_{label}.img", sectors * 512)
        kinds = set()
        try:
            out = bytearray(sectors * 512) if want else bytearray()
            for j in range(n):
                kind, _, first, count, off, size = struct.unpack_from(">IIQQQQ", raw, 204 + 40 * j)
                if kind in (0, 2, 0x7FFFFFFE, 0xFFFFFFFF):
                    continue
                kinds.add({1: "raw", 0x80000004: "ADC", 0x80000005: "zlib", 0x80000006: "bzip2", 0x80000007: "LZFSE", 0x80000008: "LZMA"}.get(kind, hex(kind)))
                if not want:
                    continue
                part = Bytes(data, fork + off).take(size)
                got = {1: lambda x: x, 0x80000004: _adc, 0x80000005: zlib.decompress, 0x80000006: bz2.decompress, 0x80000008: lzma.decompress}.get(kind)
                if got is None:
                    raise Unsupported(f"DMG block type {kind:#x}")
                out[first * 512 : first * 512 + count * 512] = got(part).ljust(count * 512, b"\0")[: count * 512]
            e.content = bytes(out) if want else None
        except (zlib.error, OSError, lzma.LZMAError, IndexError) as x:
            e.error = Corrupted(f"DMG block: {x}")
        except ArchiveError as x:
            e.error = x
        e.method = "+".join(sorted(kinds)) or None
        yield e


def udf(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """UDF volumes with 2 KiB sectors: type 1 and metadata partitions, file entries of both kinds."""
    size = 2048
    block = lambda n: Bytes(data, n * size).take(size)
    anchor = block(256)
    if at(anchor, 0, "<H") != 2:
        raise Corrupted("no UDF anchor")
    length, first = at(anchor, 16, "<II")
    starts, maps, root = {}, [], None
    for n in range(first, first + min(length // size, 256)):
        d = block(n)
        tag = at(d, 0, "<H")
        if tag == 5:
            starts[at(d, 22, "<H")] = at(d, 188, "<I")
        elif tag == 6:
            table, count = at(d, 264, "<II")
            root, p = d[248:264], 440
            for _ in range(count):
                kind, n_map = d[p], d[p + 1]
                if kind == 1:
                    maps.append(("plain", at(d, p + 4, "<H"), None))
                elif d[p + 5 : p + 28].startswith(b"*UDF Metadata Partition"):
                    maps.append(("metadata", at(d, p + 38, "<H"), at(d, p + 40, "<I")))
                else:
                    maps.append(("other", 0, None))
                p += n_map
        elif tag == 8:
            break
    if root is None or not starts:
        raise Corrupted("UDF without a logical volume")
    tables: dict[int, list[tuple[int, int]]] = {}

    def place(part: int, n: int) -> int:
        if part >= len(maps) or maps[part][1] not in starts:
            raise Corrupted("UDF partition")
        kind, number, where = maps[part]
        if kind == "other":
            raise Unsupported("UDF virtual or sparable partition")
        if kind == "metadata":
            if part not in tables:
                plain = next(i for i, m in enumerate(maps) if m[0] == "plain")
                tables[part] = [(p, s) for p, s in extents(block(starts[number] + where), plain)]
            for p, s in tables[part]:
                if n * size < s:
                    return p // size + n
                n -= s // size
            raise Corrupted("UDF metadata block")
        return starts[number] + n

    def extents(fe: bytes, part: int) -> list[tuple[int, int]]:
        """Byte places and lengths of a file's data; the place of embedded data is -1."""
        wide = at(fe, 0, "<H") == 266
        n_ea, n_ad = at(fe, 208 if wide else 168, "<II")
        p, flags = (216 if wide else 176) + n_ea, at(fe, 34, "<H") & 7
        if flags == 3:
            return [(-1, n_ad)]
        out, step, end = [], 8 if flags == 0 else 16, p + n_ad
        while p + step <= min(end, len(fe)):
            n, where = struct.unpack_from("<II", fe, p)
            ref = part if flags == 0 else struct.unpack_from("<H", fe, p + 8)[0]
            if n & 0x3FFFFFFF == 0:
                break
            if n >> 30 == 3:
                fe, p = block(place(ref, where)), 24
                end = 24 + struct.unpack_from("<I", fe, 20)[0]
                continue
            out.append((place(ref, where) * size if n >> 30 == 0 else -2, n & 0x3FFFFFFF))
            p += step
        return out

    def content(fe: bytes, part: int) -> bytes:
        total, got = at(fe, 56, "<Q"), []
        wide = at(fe, 0, "<H") == 266
        for p, n in extents(fe, part):
            if p == -1:
                start = (216 if wide else 176) + at(fe, 208 if wide else 168, "<I")
                got.append(fe[start : start + n])
            else:
                got.append(b"\0" * n if p == -2 else Bytes(data, p).take(n))
        out = b"".join(got)[:total]
        if len(out) < total:
            raise Corrupted("UDF file ends early")
        return out

    def when(fe: bytes) -> int | None:
        import calendar

        kind, y, mo, d, h, mi, s = struct.unpack_from("<HhBBBBB", fe, 92 if at(fe, 0, "<H") == 266 else 84)
        zone = (kind & 0xFFF) - (0x1000 if kind & 0x800 else 0)
        try:
            return calendar.timegm((y, mo, d, h, mi, s)) - (0 if zone == -2047 else zone * 60)
        except ValueError:
            return None

    def walk(fe: bytes, part: int, prefix: str, depth: int) -> Iterator[Entry]:
        if depth > MAX_DEPTH:
            raise Corrupted("UDF directories are too deep")
        raw, p = content(fe, part), 0
        while p + 38 <= len(raw):
            if at(raw, p, "<H") != 257:
                raise Corrupted("UDF directory record")
            flags, n = raw[p + 18], raw[p + 19]
            _, where, ref = struct.unpack_from("<IIH", raw, p + 20)
            n_use = at(raw, p + 36, "<H")
            name = raw[p + 38 + n_use : p + 38 + n_use + n]
            p += -(-(38 + n_use + n) // 4) * 4
            if flags & 0x0C or not name:
                continue
            text = name[1:].decode("utf-16-be" if name[0] in (16, 255) else "latin-1", "replace")
            child = block(place(ref, where))
            if flags & 2:
                yield Entry(f"{prefix}{text}/", 0, modified=when(child), is_directory=True)
                yield from walk(child, ref, f"{prefix}{text}/", depth + 1)
                continue
            e = Entry(prefix + text, at(child, 56, "<Q"), modified=when(child), method="store")
            if want:
                try:
                    e.content = content(child, ref)
                except ArchiveError as x:
                    e.error = x
            yield e

    _, where, part = struct.unpack_from("<IIH", root)
    files = block(place(part, where))
    if at(files, 0, "<H") != 256:
        raise Corrupted("UDF file set")
    _, where, part = struct.unpack_from("<IIH", files, 400)
    yield from walk(block(place(part, where)), part, "", 0)
