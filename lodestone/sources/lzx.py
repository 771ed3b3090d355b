"""LZX as cabinets and WIM files use it: blocks of prefix codes over literals and matches, three repeated offsets, frames of 32 KB."""

from __future__ import annotations

import struct

from .base import Corrupted, Unsupported

FRAME = 32768
_EXTRA = [0, 0, 0, 0] + [min(i // 2 - 1, 17) for i in range(4, 50)]
_BASE = [sum(1 << e for e in _EXTRA[:i]) for i in range(50)]
# Position slots of each window size (a power of two).
_SLOTS = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}


class _Codes:
    """A table over the next ``width`` bits, the first bit highest."""

    def __init__(self, lengths: list[int]):
        self.width = max(lengths, default=0)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.width)
        at = 0
        for n in range(1, self.width + 1):
            for symbol, x in enumerate(lengths):
                if x == n:
                    span = 1 << (self.width - n)
                    if at + span > len(self.table):
                        raise Corrupted("LZX code lengths")
                    self.table[at : at + span] = [(symbol, n)] * span
                    at += span


class Decoder:
    """Decodes a folder's data blocks in order; state goes on from block to block."""

    def __init__(self, window_bits: int, chunk: bool = False):
        """``chunk``: a WIM chunk, which says a block's size in another way and always translates calls."""
        if window_bits not in _SLOTS:
            raise Unsupported(f"LZX window of 2^{window_bits}")
        self.n_main, self.window = 256 + 8 * _SLOTS[window_bits], 1 << window_bits
        self.main, self.length = [0] * self.n_main, [0] * 249
        self.repeated, self.out = [1, 1, 1], bytearray()
        self.kind = self.left = 0
        self.chunk, self.begun, self.translate = chunk, chunk, 12_000_000 if chunk else 0

    def _refill(self, n: int) -> None:
        while self.have < n:
            if self.at > len(self.data) + 8:
                raise Corrupted("LZX data ends early")
            word = struct.unpack_from("<H", self.data, self.at)[0] if self.at + 2 <= len(self.data) else 0
            self.bits, self.at, self.have = self.bits << 16 | word, self.at + 2, self.have + 16

    def _take(self, n: int) -> int:
        if not n:
            return 0
        self._refill(n)
        self.have -= n
        out = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return out

    def _symbol(self, codes: _Codes) -> int:
        self._refill(codes.width)
        got = codes.table[self.bits >> (self.have - codes.width)] if codes.width else None
        if got is None:
            raise Corrupted("LZX code")
        self.have -= got[1]
        self.bits &= (1 << self.have) - 1
        return got[0]

    def _lengths(self, into: list[int], first: int, end: int) -> None:
        """Code lengths as differences to those of the block before."""
        codes, i = _Codes([self._take(4) for _ in range(20)]), first
        while i < end:
            s = self._symbol(codes)
            if s == 17:
                n, value = 4 + self._take(4), 0
            elif s == 18:
                n, value = 20 + self._take(5), 0
            elif s == 19:
                n = 4 + self._take(1)
                value = (into[i] - self._symbol(codes)) % 17
            else:
                n, value = 1, (into[i] - s) % 17
            for _ in range(min(n, end - i)):
                into[i] = value
                i += 1

    def _block(self) -> None:
        self.kind = self._take(3)
        self.left = self._take(24) if not self.chunk else FRAME if self._take(1) else self._take(16)
        if self.kind in (1, 2):
            if self.kind == 2:
                self.aligned_codes = _Codes([self._take(3) for _ in range(8)])
            self._lengths(self.main, 0, 256)
            self._lengths(self.main, 256, self.n_main)
            self._lengths(self.length, 0, 249)
            self.main_codes, self.length_codes = _Codes(self.main), _Codes(self.length)
        elif self.kind == 3:
            self._take(self.have % 16 or 16)
            self.at -= self.have // 8
            self.have = self.bits = 0
            self.repeated = list(struct.unpack_from("<III", self.data, self.at))
            self.at += 12
        else:
            raise Corrupted("LZX block type")

    def _offset(self, slot: int) -> int:
        r = self.repeated
        if slot < 3:
            r[0], r[slot] = r[slot], r[0]
            return r[0]
        extra = _EXTRA[slot]
        if self.kind == 2 and extra >= 3:
            more = (self._take(extra - 3) << 3) + self._symbol(self.aligned_codes)
        else:
            more = self._take(extra)
        self.repeated = [_BASE[slot] + more - 2, r[0], r[1]]
        return self.repeated[0]

    def frame(self, data: bytes, size: int) -> bytes:
        """The next ``size`` bytes, from one data block."""
        self.data, self.at, self.bits, self.have = data, 0, 0, 0
        if not self.begun:
            self.begun = True
            if self._take(1):
                self.translate = self._take(16) << 16 | self._take(16)
        start, out = len(self.out), self.out
        end = start + size
        try:
            while len(out) < end:
                if self.left == 0:
                    self._block()
                if self.kind == 3:
                    n = min(self.left, end - len(out))
                    piece = data[self.at : self.at + n]
                    if len(piece) < n:
                        raise Corrupted("LZX data ends early")
                    out += piece
                    self.at, self.left = self.at + n, self.left - n
                    if not self.left and n % 2:
                        self.at += 1
                    continue
                stop = min(end, len(out) + self.left)
                before = len(out)
                while len(out) < stop:
                    s = self._symbol(self.main_codes)
                    if s < 256:
                        out.append(s)
                        continue
                    n = (s - 256 & 7) + 2
                    if n == 9:
                        n += self._symbol(self.length_codes)
                    d = self._offset(s - 256 >> 3)
                    if not 0 < d <= min(len(out), self.window):
                        raise Corrupted("LZX offset")
                    while n > 0:
                        piece = out[len(out) - d : len(out) - d + n] if d >= n else out[len(out) - d :]
                        out += piece
                        n -= len(piece)
                self.left -= len(out) - before
                if len(out) > end or self.left < 0:
                    raise Corrupted("LZX match crosses a frame")
        except (struct.error, IndexError):
            raise Corrupted("LZX data ends early") from None
        got = bytes(out[start:end])
        return self._calls(got, start) if self.translate and start < FRAME * FRAME and size > 10 else got

    def _calls(self, raw: bytes, start: int) -> bytes:
        """Absolute targets of x86 calls back to relative ones."""
        b, i = bytearray(raw), 0
        while (i := b.find(b"\xe8", i, len(b) - 10)) >= 0:
            target, here = struct.unpack_from("<i", b, i + 1)[0], start + i
            if -here <= target < self.translate:
                struct.pack_into("<i", b, i + 1, target - here if target >= 0 else target + self.translate)
            i += 5
        return bytes(b)
