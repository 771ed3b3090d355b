"""Numpy side of the n-gram Jaccard join: shingle sets, class keys, parity sketches and segment signatures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from . import textkernel as tk

_C = np.uint64(0x9E3779B97F4A7C15)
#: The low bits of a signature hold its scheme.
SCHEME_BITS = 6


@dataclass(frozen=True)
class Spec:
    """Shingles of ``words`` words; sets link when ``den * |intersection| >= num * |union|``."""

    words: int = 5
    num: int = 80
    den: int = 100
    seed: int = 0

    def distance(self, total):
        """Largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    @cached_property
    def bounds(self) -> np.ndarray:
        """Size bands: scheme s is for pairs whose larger set has bounds[s] to bounds[s + 1] - 1 shingles."""
        out = [1]
        while out[-1] < 1 << 40 and len(out) < (1 << SCHEME_BITS) - 1:
            out.append(max(out[-1] + 1, out[-1] * 3 // 2))
        return np.array([*out, 1 << 62])

    @cached_property
    def furthest(self) -> np.ndarray:
        """Largest symmetric difference of linked pairs in each scheme."""
        return np.array([self.distance(2 * (int(b) - 1)) for b in self.bounds[1:]], dtype=object)

    def spare(self, scheme: np.ndarray) -> np.ndarray:
        """Segments beyond the pigeonhole's need: so many of a set's signatures may be left out without loss."""
        return 2 + self.furthest[scheme].astype(np.int64) // 8

    def segments(self, scheme: np.ndarray) -> np.ndarray:
        """Number of segments of a scheme; 0 where only equal sets link."""
        far = self.furthest[scheme].astype(np.int64)
        return np.where(far > 0, far + 1 + self.spare(scheme), 0)

    def schemes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scheme of a set's own size, and whether a linked set can be in the next larger one."""
        s = np.searchsorted(self.bounds, n, "right") - 1
        return s, self.den * n >= self.num * self.bounds[s + 1]


def shingle_sets(col, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and row offsets. A row of fewer words has one shingle."""
    buf, offs = tk.load(col)
    buf = tk.LOWER[buf]
    n = len(offs) - 1
    starts, ends, row = tk.spans(buf, offs, tk.IS_WHITE)
    h = tk.hash_spans(buf, starts, ends)
    w, at = tk.windows(h, row, spec.words, 100 + spec.seed)
    r = row[at]
    count = np.bincount(row, minlength=n)
    for k in range(1, spec.words):
        if (count == k).any():
            own = count[row] == k
            w2, at2 = tk.windows(h[own], row[own], k, 200 + 10 * spec.seed + k)
            w, r = np.concatenate((w, w2)), np.concatenate((r, row[own][at2]))
    order = np.lexsort((w, r))
    w, r = w[order], r[order]
    if len(w):
        keep = np.concatenate(([True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])))
        w, r = w[keep], r[keep]
    return w, np.searchsorted(r, np.arange(n + 1))


def row_sums(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
        return c[at[1:]] - c[at[:-1]]


def class_keys(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set; equal sets have equal hashes."""
    with np.errstate(over="ignore"):
        n = np.diff(at).astype(np.uint64)
        one = tk.mix(row_sums(tk.mix(w * _C), at) + n)
        two = tk.mix(row_sums(tk.mix(w ^ np.uint64(0x1234567F)), at) ^ n)
    return one.view(np.int64), two.view(np.int64)


def sketch_bits(n: int) -> int:
    return 1 << max(8, int(n // 2).bit_length())


def sketches(w: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parities of the shingles that fall into each of 2^k cells. Two sets' parities differ in at most as many cells
    as the sets differ in shingles."""
    out = []
    for i in range(len(at) - 1):
        own = w[at[i] : at[i + 1]]
        bits = sketch_bits(len(own))
        cell = np.bincount((own >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out.append(np.packbits(cell.astype(np.uint8)).tobytes())
    return out


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def segment_of(w: np.ndarray, m: np.ndarray, salt: int = 0) -> np.ndarray:
    """The segment of each shingle among m."""
    with np.errstate(over="ignore"):
        h = tk.mix(w ^ np.uint64(0xC0FFEE + salt))
    return (((h >> np.uint64(32)) * m.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def pick_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of the given rows, and for each the place of its row among them."""
    size = at[rows + 1] - at[rows]
    place = np.repeat(np.arange(len(rows)), size)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    return at[rows][place] + np.arange(len(place)) - first[place], place


def signatures(w: np.ndarray, at: np.ndarray, spec: Spec):
    """Hashes of the non-empty segment subsets of every row under each scheme that it takes part in.

    Returns signatures (their low bits name the scheme), their rows, and, for each (row, scheme) with empty segments,
    (row, scheme, number of them).
    """
    n = np.diff(at)
    own, more = spec.schemes(np.maximum(n, 1))
    sig, rows, empty = [], [], []
    for scheme, valid in ((own, n > 0), (own + 1, (n > 0) & more)):
        m = spec.segments(np.minimum(scheme, len(spec.bounds) - 2))
        r = np.flatnonzero(valid & (m > 0))
        if not len(r):
            continue
        pos, place = pick_rows(at, r)
        mr, sr = m[r], scheme[r]
        base = np.concatenate(([0], np.cumsum(mr)))
        cell = base[:-1][place] + segment_of(w[pos], mr[place])
        acc = np.zeros(int(base[-1]), np.uint64)
        cell_row = np.repeat(np.arange(len(r)), mr)
        with np.errstate(over="ignore"):
            np.add.at(acc, cell, tk.mix(w[pos] + np.uint64(0x51ED27)))
            j = (np.arange(int(base[-1])) - base[:-1][cell_row]).astype(np.uint64)
            s = tk.mix(acc + j * _C + sr[cell_row].astype(np.uint64) * np.uint64(0x7F4A7C159E3779B9))
        s = (s & ~np.uint64((1 << SCHEME_BITS) - 1)) | sr[cell_row].astype(np.uint64)
        full = np.zeros(int(base[-1]), bool)
        full[cell] = True
        sig.append(s[full])
        rows.append(r[cell_row[full]])
        gaps = mr - np.bincount(cell_row[full], minlength=len(r))
        e = np.flatnonzero(gaps)
        empty.append((r[e], sr[e], gaps[e]))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(sig, np.uint64), cat(rows, np.int64), tuple(cat([e[i] for e in empty], np.int64) for i in range(3))
