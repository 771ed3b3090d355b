"""Containers with plain headers: TAR, CPIO, AR and Debian packages, RPM, XAR, PAK, SARC, single streams."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from .base import Bytes, Corrupted, Entry, Unsupported


def tar(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """v7, ustar, GNU and pax archives. Links have a target and no content."""
    if data and len(data) < 512:
        raise Corrupted("TAR ends inside a header")
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            last = None
            for m in t:
                last = m
                link = m.linkname if m.issym() or m.islnk() else None
                content = None
                if want and m.isfile():
                    content = t.extractfile(m).read()
                    if len(content) < m.size:
                        raise Corrupted(f"{m.name}: data ends early")
                yield Entry(
                    m.name + ("/" if m.isdir() and not m.name.endswith("/") else ""), m.size if m.isfile() else 0, modified=int(m.mtime), is_directory=m.isdir(), method="store", mode=m.mode, link_target=link, content=content
                )
            if last is not None and last.isfile() and last.offset_data + last.size > len(data):
                raise Corrupted(f"{last.name}: data ends early")
    except (tarfile.TarError, EOFError, ValueError, OverflowError) as e:
        raise Corrupted(f"TAR: {e}") from e


def _is_tar(head: bytes) -> bool:
    """ustar mark, or a v7 header whose checksum fits."""
    if head[257:262] == b"ustar":
        return True
    if len(head) < 512 or not head[0]:
        return False
    try:
        want = int(head[148:156].strip(b"\0 ") or b"x", 8)
    except ValueError:
        return False
    return want == sum(head[:148]) + 8 * 32 + sum(head[156:512])


_CPIO = (b"070701", b"070702", b"070707")


def cpio(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """newc, crc and odc archives. Links have a target and no content."""
    b = Bytes(data)
    while True:
        start = b.at
        magic = b.take(6)
        if magic in _CPIO[:2]:
            f = [int(b.take(8), 16) for _ in range(13)]
            mode, mtime, size, name_size, pad = f[1], f[5], f[6], f[11], 4
        elif magic == _CPIO[2]:
            f = [int(b.take(n), 8) for n in (6, 6, 6, 6, 6, 6, 6, 11, 6, 11)]
            mode, mtime, name_size, size, pad = f[2], f[7], f[8], f[9], 1
        else:
            raise Unsupported("binary CPIO") if magic[:2] in (b"\xc7\x71", b"\x71\xc7") else Corrupted(f"no CPIO header at {start}")
        name = b.take(name_size)[:-1].decode("utf-8", "replace")
        b.at += -(b.at - 0) % pad
        if name == "TRAILER!!!":
            return
        body = b.take(size)
        b.at += -b.at % pad
        kind = mode & 0o170000
        is_dir, is_link = kind == 0o040000, kind == 0o120000
        while name.startswith("./"):
            name = name[2:]
        if not name or name == ".":
            continue
        yield Entry(
            name + "/" * is_dir, 0 if is_dir else size, modified=mtime, is_directory=is_dir, method="store", mode=mode & 0o7777, link_target=body.decode("utf-8", "replace") if is_link else None, content=body if want and not is_dir and not is_link else None
        )


def _ar_members(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    b, names = Bytes(data, 8), b""
    if data[:8] != b"!<arch>\n":
        raise Corrupted("not an AR archive")
    while b.at < len(data):
        if b.at + 60 > len(data):
            raise Corrupted("AR header ends early")
        h = b.take(60)
        if h[58:] != b"`\n":
            raise Corrupted("AR header without its end mark")
        try:
            size, mtime, mode = int(h[48:58]), int(h[16:28].strip() or 0), int(h[40:48].strip() or b"0", 8)
        except ValueError:
            raise Corrupted("AR header with a bad number") from None
        body = b.take(size)
        b.at += size & 1
        name = h[:16].rstrip(b" ")
        if name == b"//":
            names = body
            continue
        if name.startswith(b"#1/"):
            n = int(name[3:])
            name, body = body[:n].rstrip(b"\0"), body[n:]
        elif name.startswith(b"/") and name[1:].isdigit():
            at = int(name[1:])
            name = names[at : names.find(b"\n", at)].rstrip(b"/")
        elif name in (b"/", b"/SYM64/"):
            continue
        else:
            name = name.rstrip(b"/")
        if name.startswith(b"__.SYMDEF"):
            continue
        yield name.decode("utf-8", "replace"), mtime, mode, body


def _unpacked(name: str, body: bytes) -> bytes:
    from ..functions.codecs import decompress

    for end, codec in ((".gz", "GZIP"), (".xz", "XZ"), (".zst", "ZSTD"), (".bz2", "BZIP2"), (".lzma", "LZMA")):
        if name.endswith(end):
            return decompress(codec, body)
    return body


def ar(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """GNU and BSD archives; of a Debian package, the data files, and the control files below DEBIAN/."""
    members = list(_ar_members(data))
    if any(n == "debian-binary" for n, *_ in members):
        for name, _, _, body in members:
            if name.startswith(("data.tar", "control.tar")):
                for e in tar(_unpacked(name, body), want):
                    while e.name.startswith("./"):
                        e.name = e.name[2:]
                    if e.name:
                        if name.startswith("control"):
                            e.name = f"DEBIAN/{e.name}"
                        yield e
        return
    for name, mtime, mode, body in members:
        yield Entry(name, len(body), len(body), mtime, method="store", mode=mode & 0o7777, content=body if want else None)


def rpm(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """The CPIO payload, whatever it is compressed with."""
    from ..functions.codecs import decompress

    b = Bytes(data)
    if b.take(4) != b"\xed\xab\xee\xdb":
        raise Corrupted("not an RPM package")
    b.at = 96
    for i in range(2):
        if b.take(3) != b"\x8e\xad\xe8":
            raise Corrupted("RPM header without its mark")
        b.take(5)
        n, size = b.get(">II")
        b.take(16 * n + size)
        if i == 0:
            b.at += -b.at % 8
    body = data[b.at :]
    for mark, codec in ((b"\x1f\x8b", "GZIP"), (b"BZh", "BZIP2"), (b"\xfd7zXZ", "XZ"), (b"(\xb5/\xfd", "ZSTD"), (b"]\0\0", "LZMA")):
        if body.startswith(mark):
            body = decompress(codec, body)
            break
    yield from cpio(body, want)


def xar(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """XML table of contents and heap; extracted checksums are verified."""
    from datetime import datetime, timezone

    from ..functions.codecs import decompress

    b = Bytes(data)
    magic, size, _, packed, plain, _ = b.get(">4sHHQQI")
    if magic != b"xar!":
        raise Corrupted("not a XAR archive")
    b.at = size
    try:
        toc = zlib.decompress(b.take(packed))
        root = ElementTree.fromstring(toc)
    except (zlib.error, ElementTree.ParseError) as e:
        raise Corrupted(f"XAR contents: {e}") from e
    if len(toc) != plain:
        raise Corrupted("XAR contents have another size")
    heap = size + packed

    def walk(node, prefix) -> Iterator[Entry]:
        for f in node.findall("file"):
            kind, name = f.findtext("type", "file"), prefix + f.findtext("name", "")
            when = f.findtext("mtime")
            mtime = int(datetime.strptime(when, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp()) if when else None
            mode = int(f.findtext("mode", "0"), 8) & 0o7777 if f.findtext("mode") else None
            if kind == "directory":
                yield Entry(name + "/", 0, modified=mtime, is_directory=True, mode=mode)
                yield from walk(f, name + "/")
                continue
            e = Entry(name, modified=mtime, mode=mode, link_target=f.findtext("link") if kind == "symlink" else None)
            d = f.find("data")
            if d is not None:
                off, n, e.uncompressed_size = (int(d.findtext(k, "0")) for k in ("offset", "length", "size"))
                e.compressed_size = n
                style = d.find("encoding")
                style = style.get("style", "") if style is not None else ""
                e.method = style.rsplit("/", 1)[-1].removeprefix("x-") or "store"
                if want:
                    try:
                        raw = Bytes(data, heap + off).take(n)
                        codec = {"gzip": None, "bzip2": "BZIP2", "lzma": "LZMA", "xz": "XZ"}.get(e.method, "")
                        raw = zlib.decompress(raw) if codec is None else decompress(codec, raw) if codec else raw
                        sum_ = d.find("extracted-checksum")
                        if sum_ is not None and sum_.get("style") in hashlib.algorithms_available and hashlib.new(sum_.get("style"), raw).hexdigest() != (sum_.text or "").strip().lower():
                            raise Corrupted(f"{name}: checksum doesn't fit")
                        e.content = raw
                    except (zlib.error, Corrupted) as x:
                        e.error = x if isinstance(x, Corrupted) else Corrupted(str(x))
            elif kind == "file":
                e.uncompressed_size, e.content = 0, b"" if want else None
            yield e

    toc_node = root.find("toc")
    if toc_node is not None:
        yield from walk(toc_node, "")


def pak(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Quake PAK: a directory of 64-byte records."""
    magic, at, size = Bytes(data).get("<4sII")
    if magic != b"PACK" or size % 64:
        raise Corrupted("not a PAK archive")
    b = Bytes(data, at)
    for _ in range(size // 64):
        name, off, n = b.get("<56sII")
        body = Bytes(data, off).take(n)
        yield Entry(name.split(b"\0")[0].decode("latin-1"), n, n, method="store", content=body if want else None)


def yaz0(data: bytes) -> bytes:
    """Yaz0: bits tell literal bytes from copies."""
    if data[:4] != b"Yaz0":
        return data
    size, at, out = struct.unpack_from(">I", data, 4)[0], 16, bytearray()
    try:
        while len(out) < size:
            bits = data[at]
            at += 1
            for i in range(7, -1, -1):
                if len(out) >= size:
                    break
                if bits >> i & 1:
                    out.append(data[at])
                    at += 1
                    continue
                pair = data[at] << 8 | data[at + 1]
                at += 2
                n = pair >> 12
                if n == 0:
                    n = data[at] + 0x12
                    at += 1
                else:
                    n += 2
                start = len(out) - (pair & 0xFFF) - 1
                if start < 0:
                    raise Corrupted("Yaz0 distance out of range")
                for j in range(n):
                    out.append(out[start + j])
    except IndexError:
        raise Corrupted("Yaz0 data ends early") from None
    return bytes(out[:size])


def sarc(data: bytes, want: bool = True, **_) -> Iterator[Entry]:
    """Nintendo SARC, packed with Yaz0 or plain."""
    packed = data[:4] == b"Yaz0"
    data = yaz0(data)
    if data[:4] != b"SARC":
        raise Corrupted("not a SARC archive")
    o = ">" if data[6:8] == b"\xfe\xff" else "<"
    start = Bytes(data, 12).get(o + "I")
    b = Bytes(data, Bytes(data, 4).get(o + "H"))
    if b.take(4) != b"SFAT":
        raise Corrupted("SARC without SFAT")
    _, count, _ = b.get(o + "HHI")
    nodes = [b.get(o + "IIII") for _ in range(count)]
    names = b.at + 8
    for h, attr, first, end in nodes:
        name = Bytes(data, names + (attr & 0xFFFFFF) * 4).text().decode("utf-8", "replace") if attr >> 24 else f"{h:08x}"
        yield Entry(name, end - first, method="Yaz0" if packed else "store", content=Bytes(data, start + first).take(end - first) if want else None)


def stream(codec: str):
    """A single compressed stream: its content, or the entries of a TAR or CPIO archive inside."""

    def parse(data: bytes, want: bool = True, name: str = "", **_) -> Iterator[Entry]:
        from ..functions.codecs import decompress

        body = decompress(codec, data)
        if _is_tar(body[:512]):
            yield from tar(body, want)
        elif body[:6] in _CPIO:
            yield from cpio(body, want)
        else:
            base = name.replace("\\", "/").rsplit("/", 1)[-1]
            stem, dot, ext = base.rpartition(".")
            yield Entry(stem if dot and stem else base or "data", len(body), len(data), method=codec.lower(), content=body if want else None)

    return parse
