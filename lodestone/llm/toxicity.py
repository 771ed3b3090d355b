"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; besides each word its first four and
first five code points count as word forms, so that inflected forms share evidence. Features: words, word forms, pairs of neighbours
and pairs that skip one word, each present or absent. Per-coordinate rates and an L1 penalty leave a sparse weight
vector, of which only the non-zero part is sent to the executors. Scores are calibrated (slope and offset) on scores of
a quarter of the sample by a model that learned from the rest, and left as they are where that quarter has
fewer than ``ENOUGH`` rows of a class.

Learning uses a bounded sample (``max_train`` rows, expected) of the labelled rows that are not held out. Defined
results: a null or empty text gets the offset's probability; repeated rows are scored each on their own; an empty
table gives an empty result; without labels of both classes all scores are the smoothed base rate. Columns other than
the id and the text never reach a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow

from . import common
from . import textkernel as tk

BITS = 22
FORMS = (4, 5)
MAX_TRAIN = 8192
#: One row of the sample in so many is scored by a model that didn't learn from it, for calibration.
HELD = 4
#: Rows of either class that a calibration needs: two numbers fitted to fewer would mostly fit their noise.
ENOUGH = 50
#: Bytes between words: ASCII that is neither a digit nor a letter.
BETWEEN = tk.table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def held_out(col):
    """Rows that learning never sees: crc32 of the id as text is a multiple of 5."""
    return F.crc32(col.cast("string").cast("binary")) % 5 == 0


def _grams(col):
    """Distinct hashed features of each row."""
    buf, offs = tk.load(col)
    buf = tk.LOWER[buf]
    n = len(offs) - 1
    starts, ends, row = tk.spans(buf, offs, BETWEEN)
    h = tk.hash_spans(buf, starts, ends)
    cp = tk.code_points(buf)
    forms, first = [], np.searchsorted(cp, starts)
    for k in FORMS:
        form_ends = np.minimum(ends, np.concatenate((cp, [len(buf)]))[np.minimum(first + k, len(cp))])
        forms.append(tk.hash_spans(buf, starts, form_ends))
    pair, at2 = tk.windows(h, row, 2, 3)
    wide, at3 = tk.windows(h, row, 3, 4)
    with np.errstate(over="ignore"):
        skip = tk.mix((h[at3] ^ np.uint64(0xA5A5)) * np.uint64(0x9E3779B97F4A7C15) + h[at3 + 2])
        forms = [tk.mix(f + np.uint64(77 + i)) for i, f in enumerate(forms)]
    mask = np.uint64((1 << BITS) - 1)
    idx = np.concatenate([(x & mask).astype(np.int32) for x in (h, *forms, pair, skip)])
    rows = np.concatenate([row] * (1 + len(forms)) + [row[at2], row[at3]])
    idx, count, at = common.unique_per_row(idx, rows, n, BITS)
    return idx, np.ones(len(idx), np.float32), at


def ftrl(y, at, idx, rows=None, *, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=4) -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and weights that aren't zero, and the offset, after ``epochs`` passes over the given rows in a fixed order."""
    rows = np.arange(len(y)) if rows is None else rows
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(11)

    def weight(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for j in rng.permutation(rows):
            x = idx[at[j] : at[j + 1]]
            w = weight(z[x], n[x])
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            g = float(common.sigmoid(w.sum() + wb) - y[j])
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - sigma * w
            n[x] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = weight(z, n)
    keep = np.flatnonzero(w)
    return keep.astype(np.int32), w[keep].astype(np.float32), float(-zb / ((beta + np.sqrt(nb)) / alpha))


class ToxicityModel:
    """A sparse weight vector, an offset and a calibration of its scores."""

    def __init__(self, idx: np.ndarray, weight: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.idx, self.weight, self.offset, self.slope, self.shift = idx, weight, offset, slope, shift
        self._dense = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def score(self, col) -> np.ndarray:
        idx, _, at = _grams(col)
        return common.sigmoid(self.slope * self.sums(at, idx) + self.shift)

    def sums(self, at: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Uncalibrated log-odds of rows of features."""
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.idx] = self.weight
        return np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), self._dense[idx], len(at) - 1) + self.offset


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on at most about ``max_train`` labelled rows that aren't held out."""
    sample = common.labelled_sample(labels, id_col, label_col, max_train, keep=lambda c: ~held_out(c))
    y, at, idx, _ = common.csr(common.sparse_rows(sample, docs, id_col, text_col, _grams))
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(rate / (1 - rate))))
    held = np.arange(len(y)) % HELD == 0
    slope, shift = 1.0, 0.0
    if min(y[held].sum(), (1 - y[held]).sum()) >= ENOUGH and len(np.unique(y[~held])) == 2:
        z = ToxicityModel(*ftrl(y, at, idx, np.flatnonzero(~held))).sums(at, idx)
        slope, shift = common.platt(z[held], y[held])
    return ToxicityModel(*ftrl(y, at, idx), *((slope, shift) if slope > 0 else ()))


def score(docs: DataFrame, model: ToxicityModel, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Probability of label 1 of every document, and the label at 0.5."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, text_col):
                s = model.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return map_arrow(rows, run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, score double, predicted int")
