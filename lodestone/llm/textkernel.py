"""Vectorised tokenising and hashing of whole Arrow string columns with numpy.

Everything here works on the UTF-8 bytes of a column (``buf``) and the byte offsets of its rows (``offs``); a null
counts as an empty text. Temporary arrays are bounded by ``BLOCK`` bytes of text, whatever the length of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
WHITE = bytes([0x20, *range(0x09, 0x0E)])

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 5)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def table(chars: bytes) -> np.ndarray:
    """A 256-entry lookup that is true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_WHITE = table(WHITE)
#: A-Z to a-z, every other byte as it is: what the contracts call lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_START = (np.arange(256) & 0xC0) != 0x80


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        n = max(n, 2 * BLOCK)
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("i", _PINV)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that low bits are usable as an index."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def load(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Parts of a batch with about ``limit`` bytes of text each (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())))
    at, n = 0, batch.num_rows
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the longest runs without a ``sep`` byte, row by row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs[offs < len(buf)]] = True  # a row's first byte never continues a run
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, row


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the lines of every row, cut at each newline; an empty row has one empty line."""
    nl = np.flatnonzero(buf == 10)
    nl_row = np.searchsorted(offs, nl, "right") - 1
    n = len(offs) - 1
    starts = np.concatenate((offs[:-1], nl + 1))
    row = np.concatenate((np.arange(n), nl_row))
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.concatenate((offs[1:], nl))
    end_row = np.concatenate((np.arange(n), nl_row))
    ends = ends[np.lexsort((ends, end_row))]
    return starts, ends, row


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end]; ``starts`` ascends. Equal strings have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while at < n:
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(starts, base + limit, "left")))
            s, e = starts[at:to] - base, ends[at:to] - base
            width = int(e.max())
            p, inv = _grow(width + 1)
            c = np.empty(width + 1, np.uint64)
            c[0] = 0
            np.cumsum(_BYTE[buf[base : base + width]] * p[:width], out=c[1:])
            out[at:to] = (c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)
            at = to
        return mix(out)


def windows(h: np.ndarray, row: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k neighbouring items of one row, in order, and their rows; result i starts at item ``at[i]``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    with np.errstate(over="ignore"):
        x = np.full(len(at), np.uint64(seed * 2 + 1) * _M2, np.uint64)
        for i in range(k):
            x = (x ^ h[at + i]) * _P
            x ^= x >> np.uint64(29)
        return mix(x), at


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true bytes in each row."""
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[offs[1:]] - c[offs[:-1]]


def repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a key and a row: whether the same key stands earlier, and whether it stands elsewhere at all,
    in the same row."""
    with np.errstate(over="ignore"):
        k = mix(key + row.astype(np.uint64) * _M1)
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    later = np.zeros(len(k), bool)
    later[order[1:][same]] = True
    anywhere = later.copy()
    anywhere[order[:-1][same]] = True
    return later, anywhere


def code_points(buf: np.ndarray) -> np.ndarray:
    """Byte positions at which a code point starts."""
    return np.flatnonzero(IS_START[buf])
