"""Deflate64: deflate with a window of 64 KB, two more distance codes and a longest match of 65,538 bytes."""

from __future__ import annotations

from .base import Corrupted

# Orders and extra bits of the format.
_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
_LENGTH_BITS = [0] * 8 + [1] * 4 + [2] * 4 + [3] * 4 + [4] * 4 + [5] * 4 + [16]
_DISTANCE_BITS = [0, 0] + [i // 2 for i in range(30)]


def _bases(bits: list[int], first: int) -> list[int]:
    out = []
    for b in bits:
        out.append(first)
        first += 1 << b
    return out


#: Lengths of codes 257 to 284, then of 285, which starts at 3 again.
_LENGTHS = _bases(_LENGTH_BITS[:28], 3) + [3]
_DISTANCES = _bases(_DISTANCE_BITS, 1)


class _Tree:
    """Codes of one alphabet as a table over the next ``width`` bits (bits come in reversed)."""

    def __init__(self, lengths: list[int]):
        self.width = max(lengths, default=0)
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.width)
        code = 0
        for n in range(1, self.width + 1):
            for symbol, x in enumerate(lengths):
                if x == n:
                    back = int(format(code, f"0{n}b")[::-1], 2)
                    for i in range(back, 1 << self.width, 1 << n):
                        self.table[i] = (symbol, n)
                    code += 1
            code <<= 1


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.have, self.bits = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.have < n:
            if self.at >= len(self.data) + 8:
                raise Corrupted("Deflate64 data ends early")
            self.bits |= (self.data[self.at] if self.at < len(self.data) else 0) << self.have
            self.at += 1
            self.have += 8

    def take(self, n: int) -> int:
        self.need(n)
        out = self.bits & ((1 << n) - 1)
        self.bits >>= n
        self.have -= n
        return out

    def symbol(self, tree: _Tree) -> int:
        self.need(tree.width)
        got = tree.table[self.bits & ((1 << tree.width) - 1)] if tree.width else None
        if got is None:
            raise Corrupted("Deflate64 code")
        self.bits >>= got[1]
        self.have -= got[1]
        return got[0]


def inflate64(data: bytes) -> bytes:
    b, out, last = _Bits(data), bytearray(), 0
    while not last:
        last, kind = b.take(1), b.take(2)
        if kind == 0:
            b.take(b.have % 8)
            n, check = b.take(16), b.take(16)
            if n ^ check != 0xFFFF:
                raise Corrupted("Deflate64 stored block")
            out += bytes(b.take(8) for _ in range(n))
            continue
        if kind == 3:
            raise Corrupted("Deflate64 block type")
        if kind == 1:
            literal, distance = _Tree([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _Tree([5] * 32)
        else:
            n_lit, n_dist, n_code = b.take(5) + 257, b.take(5) + 1, b.take(4) + 4
            lengths = [0] * 19
            for i in range(n_code):
                lengths[_ORDER[i]] = b.take(3)
            codes, lengths = _Tree(lengths), []
            while len(lengths) < n_lit + n_dist:
                s = b.symbol(codes)
                if s < 16:
                    lengths.append(s)
                elif s == 16 and lengths:
                    lengths += [lengths[-1]] * (3 + b.take(2))
                else:
                    lengths += [0] * (3 + b.take(3) if s == 17 else 11 + b.take(7))
            literal, distance = _Tree(lengths[:n_lit]), _Tree(lengths[n_lit : n_lit + n_dist])
        while (s := b.symbol(literal)) != 256:
            if s < 256:
                out.append(s)
                continue
            if s > 285:
                raise Corrupted("Deflate64 length")
            n = _LENGTHS[s - 257] + b.take(_LENGTH_BITS[s - 257])
            d = b.symbol(distance)
            d = _DISTANCES[d] + b.take(_DISTANCE_BITS[d])
            if d > len(out):
                raise Corrupted("Deflate64 distance")
            while n > 0:  # a match may overlap itself
                piece = out[len(out) - d : len(out) - d + n] if d >= n else out[len(out) - d :]
                out += piece
                n -= len(piece)
        if 8 * b.at - b.have > 8 * len(data):
            raise Corrupted("Deflate64 data ends early")
    return bytes(out)
