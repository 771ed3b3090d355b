"""Stream codecs over bytes: ``decompress(name, data)`` and ``compress(name, data)``."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard

from ..sources.base import Corrupted, Unsupported


def _gunzip(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            if out and not data[at:].strip(b"\0"):
                break
            if out:
                break  # what follows the last member isn't gzip
            raise Corrupted("not a gzip member")
        d = zlib.decompressobj(31)
        out.append(d.decompress(data[at:]) + d.flush())
        if not d.eof:
            raise Corrupted("gzip member ends early")
        at = len(data) - len(d.unused_data)
    return b"".join(out)


def _lzip_decoder(code: int):
    size = 1 << (code & 31)
    size -= (size >> 4) * (code >> 5)
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])


def _lzip_members(data: bytes):
    """lzip members and where each ends: LZMA with lc 3, lp 0, pb 2, and a trailer of CRC-32, size and member size."""
    at = 0
    while data[at : at + 4] == b"LZIP":
        d = _lzip_decoder(data[at + 5])
        # the raw decoder doesn't stop at the end mark's last byte by itself, so the trailer is looked for
        text = d.decompress(data[at + 6 :])
        used = len(data) - at - 6 - len(d.unused_data) if d.eof else None
        end = at + 6 + used if used is not None else _lzip_end(data, at, text)
        crc, n, member = struct.unpack_from("<IQQ", data, end)
        if crc != zlib.crc32(text) or n != len(text) or member != end + 20 - at:
            raise Corrupted("lzip trailer doesn't fit")
        at = end + 20
        yield text, at
    if not at:
        raise Corrupted("not an lzip member")


def _unlzip(data: bytes) -> bytes:
    return b"".join(text for text, _ in _lzip_members(data))


def _lzip_end(data: bytes, at: int, text: bytes) -> int:
    want = struct.pack("<IQ", zlib.crc32(text), len(text))
    end = data.find(want, at + 6)
    if end < 0:
        raise Corrupted("lzip trailer is missing")
    return end


def _crc32c_table():
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    return table


_CRC32C = _crc32c_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC32C[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def _masked(data: bytes) -> int:
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _snappy_chunks(data: bytes):
    """The framing format: chunks of type, 24-bit length, masked CRC-32C and data."""
    at, codec = 0, pa.Codec("snappy")
    while at < len(data):
        if at + 4 > len(data):
            raise Corrupted("snappy chunk ends early")
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise Corrupted("snappy chunk ends early")
        at += 4 + n
        if kind in (0, 1):
            crc, raw = struct.unpack_from("<I", body)[0], body[4:]
            if kind == 0:
                size, shift, i = 0, 0, 0
                while True:
                    size |= (raw[i] & 0x7F) << shift
                    shift += 7
                    i += 1
                    if raw[i - 1] < 128:
                        break
                raw = codec.decompress(raw, size, asbytes=True)
            if _masked(raw) != crc:
                raise Corrupted("snappy checksum doesn't fit")
            yield raw
        elif kind < 0x80 and kind != 0xFF:
            raise Unsupported(f"snappy chunk type {kind}")


def _unsnappy(data: bytes) -> bytes:
    return b"".join(_snappy_chunks(data))


def _snappy(data: bytes) -> bytes:
    out, codec = [b"\xff\x06\x00\x00sNaPpY"], pa.Codec("snappy")
    for i in range(0, len(data), 65536):
        raw = data[i : i + 65536]
        body = struct.pack("<I", _masked(raw)) + codec.compress(raw, asbytes=True)
        out.append(b"\0" + len(body).to_bytes(3, "little") + body)
    return b"".join(out)


def _stream(name: str) -> tuple[Callable, Callable]:
    def enc(data: bytes) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, name) as f:
            f.write(data)
        return sink.getvalue().to_pybytes()

    def dec(data: bytes) -> bytes:
        with pa.CompressedInputStream(pa.BufferReader(data), name) as f:
            return f.read()

    return dec, enc


def _unzstd(data: bytes) -> bytes:
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # a frame to skip
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        d = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        while not d.eof:  # in steps, so that what follows a frame isn't copied whole
            if at >= len(data):
                raise Corrupted("zstd frame ends early")
            step = view[at : at + (1 << 17)]
            out.append(d.decompress(step))
            at += len(step)
        at -= len(d.unused_data)
    return b"".join(out)


def _unxz(data: bytes) -> bytes:
    d, out = lzma.LZMADecompressor(lzma.FORMAT_XZ), []
    while True:
        out.append(d.decompress(data))
        if not d.eof:
            raise Corrupted("xz stream ends early")
        data = d.unused_data.lstrip(b"\0")
        if not data:
            return b"".join(out)
        d = lzma.LZMADecompressor(lzma.FORMAT_XZ)


def _uncompress(data: bytes) -> bytes:
    """Unix compress: LZW with codes of 9 to 16 bits, read in groups of eight codes."""
    if data[:2] != b"\x1f\x9d" or len(data) < 3:
        raise Corrupted("not a compress stream")
    most, block = data[2] & 31, data[2] & 0x80
    if not 9 <= most <= 16:
        raise Unsupported(f"{most} bits a code")
    table = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    width, pos, base, out, last = 9, 24, 24, bytearray(), None
    bits, total = int.from_bytes(data, "little") if len(data) < 1 << 16 else None, len(data) * 8
    while pos + width <= total:
        if bits is None:
            at = pos >> 3
            code = int.from_bytes(data[at : at + 4], "little") >> (pos & 7) & ((1 << width) - 1)
        else:
            code = bits >> pos & ((1 << width) - 1)
        pos += width
        if block and code == 256:
            pos += -(pos - base) % (width * 8)
            base, width, last = pos, 9, None
            del table[257:]
            continue
        if last is None:
            if code > 255:
                raise Corrupted("first code isn't a byte")
            last = table[code]
            out += last
            continue
        if code < len(table):
            text = table[code]
        elif code == len(table):
            text = last + last[:1]
        else:
            raise Corrupted("code out of range")
        out += text
        if len(table) < 1 << most:
            table.append(last + text[:1])
            if len(table) == 1 << width and width < most:
                pos += -(pos - base) % (width * 8)
                base = pos
                width += 1
        last = text
    return bytes(out)


def _unszdd(data: bytes) -> bytes:
    """MS compress: LZSS over a 4096-byte ring that starts as spaces, at 4096 - 16."""
    if data[:8] != b"SZDD\x88\xf0\x27\x33" or len(data) < 14:
        raise Corrupted("not an SZDD file")
    size = int.from_bytes(data[10:14], "little")
    ring, at, pos, out = bytearray(b" " * 4096), 4080, 14, bytearray()
    while pos < len(data) and len(out) < size:
        flags = data[pos]
        pos += 1
        for bit in range(8):
            if len(out) >= size or pos >= len(data):
                break
            if flags >> bit & 1:
                piece = data[pos : pos + 1]
                pos += 1
            else:
                if pos + 2 > len(data):
                    break
                start, n = data[pos] | (data[pos + 1] & 0xF0) << 4, (data[pos + 1] & 15) + 3
                pos += 2
                for i in range(n):
                    b = ring[(start + i) & 4095]
                    out.append(b)
                    ring[at] = b
                    at = (at + 1) & 4095
                continue
            out += piece
            ring[at] = piece[0]
            at = (at + 1) & 4095
    if len(out) < size:
        raise Corrupted("SZDD data ends early")
    return bytes(out[:size])


def lzo1x(data: bytes, size: int) -> bytes:
    """An LZO1X block."""
    out, ip = bytearray(), 0

    def long_run(t, base, ip):
        if t == 0:
            while data[ip] == 0:
                t += 255
                ip += 1
            t += base + data[ip]
            ip += 1
        return t, ip

    def match(dist, n):
        start = len(out) - dist
        if start < 0:
            raise Corrupted("LZO distance out of range")
        for i in range(n):
            out.append(out[start + i])

    try:
        state = 0
        if data[0] > 17:
            n = data[0] - 17
            out += data[1 : 1 + n]
            ip = 1 + n
            state = min(n, 4) if n < 4 else 4
        while True:
            t = data[ip]
            ip += 1
            if t < 16:
                if state == 0:
                    n, ip = long_run(t, 15, ip)
                    out += data[ip : ip + n + 3]
                    ip += n + 3
                    state = 4
                    continue
                if state == 4:
                    match(2049 + (t >> 2) + (data[ip] << 2), 3)
                else:
                    match(1 + (t >> 2) + (data[ip] << 2), 2)
                ip += 1
                tail = t & 3
            elif t >= 64:
                match(1 + (t >> 2 & 7) + (data[ip] << 3), (t >> 5) + 1)
                ip += 1
                tail = t & 3
            elif t >= 32:
                n, ip = long_run(t & 31, 31, ip)
                d = data[ip] | data[ip + 1] << 8
                ip += 2
                match(1 + (d >> 2), n + 2)
                tail = d & 3
            else:
                n, ip = long_run(t & 7, 7, ip)
                d = data[ip] | data[ip + 1] << 8
                ip += 2
                dist = (t & 8) << 11 | d >> 2
                if dist == 0:
                    break
                match(dist + 16384, n + 2)
                tail = d & 3
            out += data[ip : ip + tail]
            ip += tail
            state = tail
    except IndexError:
        raise Corrupted("LZO block ends early") from None
    if len(out) != size:
        raise Corrupted("LZO block has another size")
    return bytes(out)


def _lzop_blocks(data: bytes):
    if data[:9] != b"\x89LZO\0\r\n\x1a\n":
        raise Corrupted("not an lzop file")
    try:
        version = struct.unpack_from(">H", data, 9)[0]
        at = 9 + 2 + 2 + (2 if version >= 0x940 else 0) + 1 + (1 if version >= 0x940 else 0)
        flags = struct.unpack_from(">I", data, at)[0]
        at += 4 + (4 if flags & 0x800 else 0) + 4 + 4 + (4 if version >= 0x940 else 0)
        at += 1 + data[at] + 4
        if flags & 0x40:
            at += 4 + struct.unpack_from(">I", data, at)[0] + 4
        while True:
            n = struct.unpack_from(">I", data, at)[0]
            at += 4
            if n == 0:
                return
            c = struct.unpack_from(">I", data, at)[0]
            at += 4
            sums = []
            for bit, check in ((0x1, zlib.adler32), (0x100, zlib.crc32)):
                if flags & bit:
                    sums.append((check, struct.unpack_from(">I", data, at)[0]))
                    at += 4
            if c < n:
                at += 4 * sum(bool(flags & b) for b in (0x2, 0x200))
            raw = data[at : at + c]
            if len(raw) < c:
                raise Corrupted("lzop block ends early")
            at += c
            raw = raw if c == n else lzo1x(raw, n)
            if any(check(raw) != want for check, want in sums):
                raise Corrupted("lzop checksum doesn't fit")
            yield raw
    except (struct.error, IndexError):
        raise Corrupted("lzop file ends early") from None


def _unlzop(data: bytes) -> bytes:
    return b"".join(_lzop_blocks(data))


_brotli, _lz4 = _stream("brotli"), _stream("lz4")
DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "GZIP": _gunzip, "BZIP2": bz2.decompress, "XZ": _unxz, "LZMA": lambda d: lzma.decompress(d, lzma.FORMAT_ALONE), "ZSTD": _unzstd, "LZ4": _lz4[0],
    "BROTLI": _brotli[0], "SNAPPY": _unsnappy, "LZIP": _unlzip, "LZOP": _unlzop, "Z": _uncompress, "MSLZ": _unszdd,
}


def _lzip(data: bytes) -> bytes:
    c = lzma.LZMACompressor(lzma.FORMAT_ALONE, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 23, "lc": 3, "lp": 0, "pb": 2}])
    raw = (c.compress(data) + c.flush())[13:]
    return b"LZIP\x01\x17" + raw + struct.pack("<IQQ", zlib.crc32(data), len(data), 6 + len(raw) + 20)


ENCODERS: dict[str, Callable[..., bytes]] = {
    "GZIP": lambda d, level=6: gzip.compress(d, level, mtime=0), "BZIP2": lambda d, level=9: bz2.compress(d, level), "XZ": lambda d, level=6: lzma.compress(d, preset=level),
    "LZMA": lambda d, level=6: lzma.compress(d, lzma.FORMAT_ALONE, preset=level), "ZSTD": lambda d, level=3: zstandard.ZstdCompressor(level=min(max(level, 1), 12), write_checksum=True).compress(d),
    "LZ4": lambda d, level=0: _lz4[1](d), "BROTLI": lambda d, level=0: _brotli[1](d), "SNAPPY": lambda d, level=0: _snappy(d), "LZIP": lambda d, level=6: _lzip(d),
}


def decompress(codec: str, data: bytes) -> bytes:
    """All of a stream; raises Corrupted or Unsupported."""
    if codec not in DECODERS:
        raise Unsupported(f"no decoder for {codec}")
    if not data:
        raise Corrupted("empty stream")
    try:
        return DECODERS[codec](data)
    except (Corrupted, Unsupported):
        raise
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError, IndexError, struct.error) as e:
        raise Corrupted(f"{codec}: {e}") from e


def compress(codec: str, data: bytes, level: int | None = None) -> bytes:
    if codec not in ENCODERS:
        raise Unsupported(f"{codec} can't be written")
    return ENCODERS[codec](data) if level is None else ENCODERS[codec](data, level)


def _zstd_decoder():
    return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()


def _prefix(make: Callable, data: bytes, step: int, skip: Callable | None = None) -> bytes:
    """What decoders give up to the damage, a new one for each member or frame; ``skip`` says what isn't one."""
    out, at = bytearray(), 0
    while at < len(data):
        if skip and (n := skip(data, at)):
            at += n
            continue
        d, start = make(), at
        try:
            while at < len(data) and not d.eof:
                out += d.decompress(data[at : at + step])
                at += step
        except Exception:  # noqa: BLE001  whatever a decoder says, what came before it counts
            d = make()  # the step that failed once more, byte by byte
            try:
                if at > start:
                    d.decompress(data[start:at])
                for i in range(at, min(at + step, len(data))):
                    out += d.decompress(data[i : i + 1])
            except Exception:  # noqa: BLE001
                pass
            break
        if not d.eof:
            break
        at = min(at, len(data)) - len(d.unused_data)
    return bytes(out)


class _Slow(io.RawIOBase):
    """A file that gives few bytes at once, and from some place on a single one."""

    def __init__(self, data: bytes, step: int, single: int):
        self.data, self.step, self.single, self.at = data, step, single, 0

    def readable(self):
        return True

    def read(self, n=-1):
        m = self.step if self.at < self.single else 1
        got = self.data[self.at : self.at + (m if n < 0 else min(n, m))]
        self.at += len(got)
        return got


def _arrow_prefix(name: str, data: bytes, step: int) -> bytes:
    """The same for Arrow's decoders: read in pieces, then up to the error byte by byte."""
    sure, single = bytearray(), len(data)
    for size in (4096, 1):
        raw, got = _Slow(data, step, single), bytearray()
        try:
            with pa.CompressedInputStream(pa.PythonFile(raw, mode="r"), name) as f:
                if size == 1 and sure:
                    got += f.read(len(sure))
                while piece := f.read(size):
                    got += piece
        except Exception:  # noqa: BLE001
            pass
        sure, single = max(sure, got, key=len), max(0, raw.at - 2 * step)
    return bytes(sure)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return value, at
        if shift > 63:
            raise Corrupted("xz number is too long")


def _xz_prefix(data: bytes, step: int) -> bytes:
    """Every block that a readable index names, whole or up to its damage; streams before them up to the damage."""
    parts, end = [], len(data)
    try:
        while end >= 32:
            if not data[end - 4 : end].strip(b"\0"):  # padding between streams
                end -= 4
                continue
            crc, back, flags, magic = struct.unpack_from("<II2s2s", data, end - 12)
            index = end - 12 - 4 * (back + 1)
            if magic != b"YZ" or crc != zlib.crc32(data[end - 8 : end - 2]) or index < 12 or data[index] or zlib.crc32(data[index : end - 16]) != struct.unpack_from("<I", data, end - 16)[0]:
                break
            n, at = _varint(data, index + 1)
            sizes = []
            for _ in range(n):
                unpadded, at = _varint(data, at)
                _, at = _varint(data, at)
                sizes.append(-(-unpadded // 4) * 4)
            start = index - sum(sizes)
            if start < 12:
                break
            head = b"\xfd7zXZ\0" + flags + struct.pack("<I", zlib.crc32(flags))  # the stream's own may be damaged
            got = []
            for size in sizes:
                got.append(_prefix(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), head + data[start : start + size], step))
                start += size
            parts[:0] = got
            end = index - sum(sizes) - 12
    except (Corrupted, IndexError, struct.error):
        pass
    return _prefix(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), data[:end], step, lambda d, at: 4 if at and d[at : at + 4] == b"\0" * 4 else 0) + b"".join(parts)


def partial(codec: str, data: bytes, step: int = 256) -> tuple[bytes, bool]:
    """What comes out of a stream before it is damaged, and whether it is whole.

    LZ4, Snappy and lzop give whole blocks, xz also the blocks after the damage; compress and SZDD give nothing.
    """
    try:
        return decompress(codec, data), True
    except (Corrupted, Unsupported):
        pass
    out = bytearray()
    if codec == "GZIP":
        return _prefix(lambda: zlib.decompressobj(31), data, step), False
    if codec == "ZSTD":
        return _prefix(_zstd_decoder, data, step, lambda d, at: 8 + int.from_bytes(d[at + 4 : at + 8], "little") if 0x184D2A50 <= int.from_bytes(d[at : at + 4], "little") <= 0x184D2A5F else 0), False
    if codec == "BZIP2":
        return _prefix(bz2.BZ2Decompressor, data, step), False
    if codec == "LZMA":
        return _prefix(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), data, step), False
    if codec == "XZ":
        return _xz_prefix(data, step), False
    if codec in ("LZ4", "BROTLI"):
        return _arrow_prefix(codec.lower(), data, step), False
    if codec in ("SNAPPY", "LZOP"):
        try:
            for piece in (_snappy_chunks if codec == "SNAPPY" else _lzop_blocks)(data):
                out += piece
        except Exception:  # noqa: BLE001
            pass
    elif codec == "LZIP":
        at = 0
        try:
            for text, end in _lzip_members(data):
                out += text
                at = end
        except Exception:  # noqa: BLE001
            if data[at : at + 4] == b"LZIP" and len(data) > at + 6:
                out += _prefix(lambda: _lzip_decoder(data[at + 5]), data[at + 6 :], step)
    return bytes(out), False
