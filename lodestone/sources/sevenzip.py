"""7z archives: header records, folders (solid blocks) of chained coders."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib
from collections.abc import Iterator

from .aes import AES
from .base import ArchiveError, Bytes, Corrupted, Encrypted, Entry, Unsupported, file_time

MARK = b"7z\xbc\xaf\x27\x1c"
# Coder ids.
CODERS = {
    b"\0": "Copy", b"\x03": "Delta", b"\x04": "BCJ", b"\x21": "LZMA2", b"\x03\x01\x01": "LZMA", b"\x03\x03\x01\x03": "BCJ", b"\x03\x03\x01\x1b": "BCJ2",
    b"\x03\x03\x02\x05": "PPC", b"\x03\x03\x04\x01": "IA64", b"\x03\x03\x05\x01": "ARM", b"\x03\x03\x07\x01": "ARMT", b"\x03\x03\x08\x05": "SPARC",
    b"\x03\x04\x01": "PPMd", b"\x04\x01\x08": "Deflate", b"\x04\x01\x09": "Deflate64", b"\x04\x02\x02": "BZip2", b"\x04\xf7\x11\x01": "Zstandard",
    b"\x06\xf1\x07\x01": "AES256SHA256",
}
_FILTERS = {"BCJ": lzma.FILTER_X86, "PPC": lzma.FILTER_POWERPC, "IA64": lzma.FILTER_IA64, "ARM": lzma.FILTER_ARM, "ARMT": lzma.FILTER_ARMTHUMB, "SPARC": lzma.FILTER_SPARC}
MAX_ROUNDS = 24


class _Reader(Bytes):
    def number(self) -> int:
        first = self.u8()
        value, mask = 0, 0x80
        for i in range(8):
            if not first & mask:
                return value | (first & (mask - 1)) << (8 * i)
            value |= self.u8() << (8 * i)
            mask >>= 1
        return value

    def count(self, most: int = 10_000_000) -> int:
        n = self.number()
        if n > most:
            raise Corrupted("7z count out of range")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i >> 3] >> (7 - i % 8) & 1) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.u8() else self.bits(n)


class Folder:
    def __init__(self, r: _Reader):
        self.coders, ins, outs = [], 0, 0
        for _ in range(r.count(32)):
            flag = r.u8()
            cid = r.take(flag & 15)
            n_in, n_out = (r.count(32), r.count(32)) if flag & 0x10 else (1, 1)
            self.coders.append((CODERS.get(cid, cid.hex()), r.take(r.count()) if flag & 0x20 else b"", n_in, n_out))
            ins, outs = ins + n_in, outs + n_out
        self.binds = [(r.number(), r.number()) for _ in range(outs - 1)]
        packed = ins - len(self.binds)
        bound = {i for i, _ in self.binds}
        self.packed = [next(i for i in range(ins) if i not in bound)] if packed == 1 else [r.number() for _ in range(packed)]
        self.sizes, self.crc, self.outs = [], None, outs

    @property
    def method(self) -> str:
        return " ".join(c[0] for c in reversed(self.coders))

    @property
    def encrypted(self) -> bool:
        return any(c[0] == "AES256SHA256" for c in self.coders)

    def size(self) -> int:
        bound = {o for _, o in self.binds}
        return self.sizes[next(i for i in range(self.outs) if i not in bound)]

    def decode(self, streams: list[bytes], password: str | None) -> bytes:
        if any(c[2] != 1 or c[3] != 1 for c in self.coders):
            raise Unsupported(self.method)
        feeds = dict(self.binds)  # input -> output that feeds it
        order, i = [], next(i for i in range(len(self.coders)) if i not in feeds.values())
        while True:
            order.append(i)
            if i not in feeds:
                break
            i = feeds[i]
        data = streams[0]
        chain: list[dict] = []
        for n in reversed(order):
            name, props, _, _ = self.coders[n]
            if name in _FILTERS or name == "Delta":
                chain.insert(0, {"id": lzma.FILTER_DELTA, "dist": props[0] + 1} if name == "Delta" else {"id": _FILTERS[name]})
                if chain and chain[-1]["id"] not in (lzma.FILTER_LZMA1, lzma.FILTER_LZMA2):
                    data, chain = _simple(data, chain), []
                elif chain[-1]["id"] == lzma.FILTER_LZMA1:  # liblzma can't end such a chain by itself
                    data, chain = _raw(data, chain[-1:], self.sizes[prev]), []  # noqa: F821
                    data = _simple(data, [{"id": lzma.FILTER_DELTA, "dist": props[0] + 1} if name == "Delta" else {"id": _FILTERS[name]}])
                prev = n
                continue
            if chain:
                data, chain = _raw(data, chain, self.sizes[prev]), []
            if name == "LZMA":
                lp = props[0] // 9
                chain = [{"id": lzma.FILTER_LZMA1, "lc": props[0] % 9, "lp": lp % 5, "pb": lp // 5, "dict_size": max(4096, struct.unpack_from("<I", props, 1)[0])}]
            elif name == "LZMA2":
                bits = props[0]
                chain = [{"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << (bits // 2 + 11)}]
            elif name == "Deflate":
                data = zlib.decompressobj(-15).decompress(data)
            elif name == "BZip2":
                data = bz2.decompress(data)
            elif name == "Zstandard":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif name == "AES256SHA256":
                data = _decrypt(data, props, password)[: self.sizes[n]]
            elif name != "Copy":
                raise Unsupported(name)
            prev = n
        return _raw(data, chain, self.sizes[prev]) if chain else data[: self.sizes[prev]]


def _raw(data: bytes, chain: list[dict], size: int) -> bytes:
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain)
    out = d.decompress(data, max_length=size) if size else b""
    while len(out) < size and not d.eof:
        more = d.decompress(b"", max_length=size - len(out))
        if not more:
            break
        out += more
    if len(out) < size:
        raise Corrupted("LZMA data ends early")
    return out


def _simple(data: bytes, chain: list[dict]) -> bytes:
    """Filters alone: liblzma wants a coder behind them, so the data pass through uncompressed LZMA2 chunks."""
    body = b"".join(b"\x01" + struct.pack(">H", len(c := data[i : i + 65536]) - 1) + c for i in range(0, len(data), 65536)) + b"\0"
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*chain, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]).decompress(body)


def _decrypt(data: bytes, props: bytes, password: str | None) -> bytes:
    if password is None:
        raise Encrypted("a password is needed")
    rounds, flags = props[0] & 63, props[0]
    salt = iv = b""
    if flags & 0xC0:
        s, v = (flags >> 7 & 1) + (props[1] >> 4), (flags >> 6 & 1) + (props[1] & 15)
        salt, iv = props[2 : 2 + s], props[2 + s : 2 + s + v]
    if rounds > MAX_ROUNDS:
        raise Unsupported(f"2^{rounds} key rounds")
    secret, h = salt + password.encode("utf-16-le"), hashlib.sha256()
    for i in range(0, 1 << rounds, 1 << 12):
        h.update(b"".join(secret + struct.pack("<Q", j) for j in range(i, min(i + (1 << 12), 1 << rounds))))
    return AES(h.digest()).cbc(data, iv.ljust(16, b"\0"))


def _streams(r: _Reader) -> tuple[int, list[int], list[Folder], list[list[tuple[int, int | None]]]]:
    at, sizes, folders, parts = 0, [], [], None
    while (kind := r.number()) != 0:
        if kind == 6:
            at, n = r.number(), r.count()
            while (k := r.number()) != 0:
                if k == 9:
                    sizes = [r.number() for _ in range(n)]
                elif k == 10:
                    [r.take(4) for d in r.defined(n) if d]
        elif kind == 7:
            if r.number() != 11:
                raise Corrupted("7z folders are missing")
            n = r.count()
            if r.u8():
                raise Unsupported("external 7z folders")
            folders = [Folder(r) for _ in range(n)]
            while (k := r.number()) != 0:
                if k == 12:
                    for f in folders:
                        f.sizes = [r.number() for _ in range(f.outs)]
                elif k == 10:
                    for f, d in zip(folders, r.defined(n)):
                        if d:
                            f.crc = r.get("<I")
        elif kind == 8:
            counts = [1] * len(folders)
            parts = [[] for _ in folders]
            k = r.number()
            if k == 13:
                counts = [r.count() for _ in folders]
                k = r.number()
            for f, c, p in zip(folders, counts, parts):
                left = f.size()
                for i in range(c):
                    n = r.number() if k == 9 and i < c - 1 else left
                    left -= n
                    p.append([n, f.crc if c == 1 else None])
            if k == 9:
                k = r.number()
            while k != 0:
                if k == 10:
                    open_ = [x for p in parts for x in p if x[1] is None]
                    for x, d in zip(open_, r.defined(len(open_))):
                        if d:
                            x[1] = r.get("<I")
                k = r.number()
        else:
            raise Corrupted(f"7z record {kind}")
    if parts is None:
        parts = [[[f.size(), f.crc]] for f in folders]
    return at, sizes, folders, parts


def _packed(data: bytes, at: int, sizes: list[int], folders: list[Folder]):
    """The packed streams of each folder."""
    pos, i = 32 + at, 0
    for f in folders:
        got = []
        for _ in f.packed:
            got.append((pos, sizes[i]))
            pos += sizes[i]
            i += 1
        yield [Bytes(data, p).take(n) for p, n in got]


def _guarded(f: Folder, streams: list[bytes], password: str | None) -> bytes:
    try:
        return f.decode(streams, password)
    except ArchiveError as e:
        raise Encrypted("wrong password") if f.encrypted and isinstance(e, Corrupted) else e from e
    except (lzma.LZMAError, zlib.error, OSError, EOFError, ValueError, IndexError, struct.error) as e:
        raise (Encrypted("wrong password") if f.encrypted else Corrupted(f"{f.method}: {e}")) from e


def entries(data: bytes, want: bool = True, password: str | None = None, **_) -> Iterator[Entry]:
    if data[:6] != MARK:
        raise Corrupted("not a 7z archive")
    crc, offset, size, next_crc = Bytes(data, 8).get("<IQQI")
    if zlib.crc32(data[12:32]) != crc:
        raise Corrupted("7z start header CRC doesn't fit")
    if size == 0:
        return
    head = Bytes(data, 32 + offset).take(size)
    if zlib.crc32(head) != next_crc:
        raise Corrupted("7z header CRC doesn't fit")
    r = _Reader(head)
    kind = r.number()
    while kind == 23:
        at, sizes, folders, _ = _streams(r)
        if len(folders) != 1:
            raise Corrupted("7z encoded header")
        head = _guarded(folders[0], next(_packed(data, at, sizes, folders)), password)
        if folders[0].crc is not None and zlib.crc32(head) != folders[0].crc:
            raise Encrypted("wrong password") if folders[0].encrypted else Corrupted("7z header CRC doesn't fit")
        r = _Reader(head)
        kind = r.number()
    if kind != 1:
        raise Corrupted("7z header is missing")
    at, sizes, folders, parts, files = 0, [], [], [], None
    while (kind := r.number()) != 0:
        if kind == 2:
            while r.number() != 0:
                r.take(r.count())
        elif kind == 4:
            at, sizes, folders, parts = _streams(r)
        elif kind == 5:
            files = _files(r)
        else:
            raise Corrupted(f"7z record {kind}")
    slots = [(i, j) for i, p in enumerate(parts) for j in range(len(p))]
    packed, decoded = list(_packed(data, at, sizes, folders)) if want else [], {}
    n = 0
    for f in files or []:
        e = Entry(f["name"] + "/" * f["dir"], 0, modified=f["time"], is_directory=f["dir"], mode=f["attr"] >> 16 & 0o7777 if f["attr"] & 0x8000 and f["attr"] >> 16 else None)
        if f["stream"]:
            if n >= len(slots):
                raise Corrupted("7z has more files than streams")
            i, j = slots[n]
            n += 1
            e.uncompressed_size, e.crc32 = parts[i][j]
            e.method, e.is_encrypted = folders[i].method, folders[i].encrypted
            e.compressed_size = sum(sizes[sum(len(x.packed) for x in folders[:i]) :][: len(folders[i].packed)]) if len(parts[i]) == 1 else None
            if want:
                if i not in decoded:
                    decoded.clear()  # one solid block at a time
                    try:
                        decoded[i] = _guarded(folders[i], packed[i], password)
                    except ArchiveError as x:
                        decoded[i] = x
                body = decoded[i]
                if isinstance(body, ArchiveError):
                    e.error = body
                else:
                    first = sum(p[0] for p in parts[i][:j])
                    e.content = body[first : first + e.uncompressed_size]
                    if e.crc32 is not None and zlib.crc32(e.content) != e.crc32:
                        e.error, e.content = Encrypted("wrong password") if e.is_encrypted else Corrupted("CRC doesn't fit"), None
        elif not f["dir"]:
            e.content = b"" if want else None
        if e.content is not None and f["attr"] >> 16 & 0o170000 == 0o120000:
            e.link_target, e.content = e.content.decode("utf-8", "replace"), None
        yield e


def _files(r: _Reader) -> list[dict]:
    n = r.count()
    files = [{"name": "", "stream": True, "dir": False, "time": None, "attr": 0} for _ in range(n)]
    empty = []
    while (kind := r.number()) != 0:
        b = _Reader(r.take(r.count(1 << 31)))
        if kind == 14:
            empty = [i for i, x in enumerate(b.bits(n)) if x]
            for i in empty:
                files[i]["stream"], files[i]["dir"] = False, True
        elif kind == 15:
            for i, x in zip(empty, b.bits(len(empty))):
                files[i]["dir"] = not x
        elif kind == 17:
            if b.u8():
                raise Unsupported("external 7z names")
            names = b.data[1:].decode("utf-16-le", "replace").split("\0")
            for f, name in zip(files, names):
                f["name"] = name
        elif kind in (20, 21):
            has = b.defined(n)
            if b.u8():
                raise Unsupported("external 7z times")
            for f, x in zip(files, has):
                if x:
                    f["time" if kind == 20 else "attr"] = file_time(b.get("<Q")) if kind == 20 else b.get("<I")
    return files


def write(files: list[tuple[str, bytes | None, int | None]], level: int = 6) -> bytes:
    """One solid LZMA2 folder; content None is a folder."""
    bodies = [c for _, c, _ in files if c]
    plain = b"".join(bodies)
    filters = [{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": 1 << 24}]
    c = lzma.LZMACompressor(lzma.FORMAT_RAW, filters=filters)
    packed = c.compress(plain) + c.flush() if plain else b""

    def num(v: int) -> bytes:
        for i in range(8):
            if v < 1 << (7 * (i + 1)):
                return bytes([0xFF << (8 - i) & 0xFF | v >> (8 * i)]) + (v & (1 << (8 * i)) - 1).to_bytes(i, "little")
        return b"\xff" + v.to_bytes(8, "little")

    def mask(flags) -> bytes:
        out = bytearray((len(flags) + 7) // 8)
        for i, f in enumerate(flags):
            out[i >> 3] |= bool(f) << (7 - i % 8)
        return bytes(out)

    head = b"\x01"
    if bodies:
        head += b"\x04\x06" + num(0) + num(1) + b"\x09" + num(len(packed)) + b"\0"
        head += b"\x07\x0b" + num(1) + b"\0" + num(1) + b"\x21\x21" + num(1) + b"\x18" + b"\x0c" + num(len(plain)) + b"\0"
        head += b"\x08\x0d" + num(len(bodies)) + (b"\x09" + b"".join(num(len(x)) for x in bodies[:-1]) if len(bodies) > 1 else b"")
        head += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(x)) for x in bodies) + b"\0\0"
    head += b"\x05" + num(len(files))

    def prop(kind: int, body: bytes) -> bytes:
        return bytes([kind]) + num(len(body)) + body

    none = [not content for _, content, _ in files]
    if any(none):
        head += prop(14, mask(none)) + prop(15, mask([content is not None for _, content, _ in files if not content]))
    head += prop(17, b"\0" + b"".join(n.rstrip("/").encode("utf-16-le") + b"\0\0" for n, _, _ in files))
    if all(t is not None for _, _, t in files):
        head += prop(20, b"\x01\0" + b"".join(struct.pack("<Q", (t + 11_644_473_600) * 10_000_000) for _, _, t in files))
    head += b"\0\0"
    start = struct.pack("<QQI", len(packed), len(head), zlib.crc32(head))
    return MARK + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + packed + head
