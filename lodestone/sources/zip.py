"""ZIP archives, by their central directory."""

from __future__ import annotations

import bz2
import hashlib
import hmac
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import zstandard

from .aes import AES
from .base import ArchiveError, Bytes, Corrupted, Encrypted, Entry, Unsupported, dos_time
from .deflate64 import inflate64

# Names of the compression methods.
METHODS = {0: "Store", 8: "Deflate", 9: "Deflate64", 12: "BZIP2", 14: "LZMA", 93: "Zstandard", 95: "XZ", 98: "PPMd", 99: "AES"}


def _extras(raw: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(raw):
        kind, n = struct.unpack_from("<HH", raw, at)
        out[kind] = raw[at + 4 : at + 4 + n]
        at += 4 + n
    return out


def inflate(method: int, raw: bytes, size: int) -> bytes:
    """Decoded data of one entry."""
    try:
        if method == 0:
            return raw
        if method == 8:
            d = zlib.decompressobj(-15)
            out = d.decompress(raw) + d.flush()
            if not d.eof:
                raise Corrupted("deflate data ends early")
            return out
        if method == 9:
            return inflate64(raw)
        if method == 12:
            return bz2.decompress(raw)
        if method == 14:
            n = struct.unpack_from("<H", raw, 2)[0]
            return zipfile._get_decompressor(14).decompress(raw) if n == 5 else b""
        if method == 93:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if method == 95:
            return lzma.decompress(raw)
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError, struct.error) as e:
        raise Corrupted(str(e)) from e
    raise Unsupported(f"method {METHODS.get(method, method)}")


def _aes(raw: bytes, extra: bytes, password: bytes) -> tuple[int, bytes, int]:
    """WinZip AES: method, plain data, vendor version."""
    version, _, strength, method = struct.unpack_from("<H2sBH", extra)
    n = {1: 16, 2: 24, 3: 32}.get(strength)
    if n is None:
        raise Unsupported("AES strength")
    salt, check, body, mac = raw[: n // 2], raw[n // 2 : n // 2 + 2], raw[n // 2 + 2 : -10], raw[-10:]
    key = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * n + 2)
    if key[2 * n :] != check:
        raise Encrypted("wrong password")
    if hmac.new(key[n : 2 * n], body, hashlib.sha1).digest()[:10] != mac:
        raise Corrupted("AES authentication fails")
    return method, AES(key[:n]).ctr_le(body), version


def entries(data: bytes, want: bool = True, password: str | None = None, **_) -> Iterator[Entry]:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, struct.error, ValueError, NotImplementedError) as e:
        raise Corrupted(f"ZIP: {e}") from e
    secret = password.encode() if password is not None else None
    for i in z.infolist():
        extra = _extras(i.extra)
        encrypted, method = bool(i.flag_bits & 1), i.compress_type
        if method == 99 and 0x9901 in extra:
            method = struct.unpack_from("<H", extra[0x9901], 5)[0]
        stamp = extra.get(0x5455, b"")
        y, mo, d, h, mi, s = i.date_time
        modified = struct.unpack_from("<i", stamp, 1)[0] if len(stamp) >= 5 and stamp[0] & 1 else dos_time((y - 1980) << 9 | mo << 5 | d, h << 11 | mi << 5 | s >> 1)
        mode = i.external_attr >> 16
        kind = mode & 0o170000
        e = Entry(
            i.filename, i.file_size, i.compress_size, modified, i.is_dir(), encrypted, None if i.is_dir() else i.CRC & 0xFFFFFFFF, METHODS.get(method, str(method)), mode & 0o7777 if mode else None, comment=i.comment.decode("utf-8", "replace") or None
        )
        if (want or kind == 0o120000) and not e.is_directory:
            try:
                e.content = _content(z, i, extra, secret)
            except ArchiveError as x:
                e.error = x
        if kind == 0o120000 and e.content is not None:
            e.link_target, e.content = e.content.decode("utf-8", "replace"), None
        yield e


def _content(z: zipfile.ZipFile, i: zipfile.ZipInfo, extra: dict[int, bytes], secret: bytes | None) -> bytes:
    if i.flag_bits & 0x40:
        raise Unsupported("strong encryption")
    if i.flag_bits & 1 and secret is None:
        raise Encrypted("a password is needed")
    check = True
    if i.compress_type in (0, 8, 12, 14):
        try:
            return z.read(i, pwd=secret)
        except RuntimeError as x:
            raise Encrypted(str(x)) from x
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, lzma.LZMAError, struct.error) as x:
            raise Corrupted(str(x)) from x
    b = Bytes(z.fp.getvalue(), i.header_offset + 26)
    n, m = b.get("<HH")
    b.take(n + m)
    raw, method = b.take(i.compress_size), i.compress_type
    if method == 99:
        method, raw, version = _aes(raw, extra.get(0x9901, b"\0" * 7), secret or b"")
        check = version == 1
    out = inflate(method, raw, i.file_size)
    if len(out) != i.file_size or check and zlib.crc32(out) != i.CRC & 0xFFFFFFFF:
        raise Corrupted("size or CRC doesn't fit")
    return out
