"""What every parser shares: errors as values, entries, reading of integers."""

from __future__ import annotations

import struct
from dataclasses import dataclass


class ArchiveError(Exception):
    """An archive, or an entry, that can't be read."""

    kind = "Error"


class Corrupted(ArchiveError):
    kind = "Corrupted"


class Encrypted(ArchiveError):
    kind = "Encrypted"


class Unsupported(ArchiveError):
    kind = "Unsupported"


class LimitExceeded(ArchiveError):
    kind = "LimitExceeded"


@dataclass
class Entry:
    """One entry; unknown values are None. ``error`` marks an entry whose content can't be had."""

    name: str
    uncompressed_size: int | None = None
    compressed_size: int | None = None
    modified: int | None = None
    is_directory: bool = False
    is_encrypted: bool = False
    crc32: int | None = None
    method: str | None = None
    mode: int | None = None
    link_target: str | None = None
    comment: str | None = None
    content: bytes | None = None
    error: ArchiveError | None = None


class Bytes:
    """Reads integers and slices at offsets; what lies beyond the end raises Corrupted."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Corrupted("data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, fmt: str):
        got = struct.unpack(fmt, self.take(struct.calcsize(fmt)))
        return got[0] if len(got) == 1 else got

    def u8(self) -> int:
        return self.take(1)[0]

    def text(self, stop: bytes = b"\0") -> bytes:
        end = self.data.find(stop, self.at)
        if end < 0:
            raise Corrupted("text without an end")
        out = self.data[self.at : end]
        self.at = end + len(stop)
        return out


def at(data: bytes, offset: int, fmt: str):
    """Integers at an offset."""
    return Bytes(data, offset).get(fmt)


def dos_time(date: int, time: int) -> int | None:
    """Seconds since 1970 of a DOS date and time, taken as UTC."""
    import calendar

    if not date:
        return None
    try:
        return calendar.timegm((1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2))
    except (ValueError, OverflowError):
        return None


def file_time(ticks: int) -> int | None:
    """Seconds since 1970 of a Windows time (100 ns since 1601)."""
    return ticks // 10_000_000 - 11_644_473_600 if ticks else None
