"""Quality rules: fixed base rules, then a hashed word and character n-gram logistic regression.

The model is trained on a bounded sample of labelled rows (``max_train`` of them, expected), calibrated on a part of
the sample that the fit didn't see (on the fitted rows where that part, a fifth, lacks a class), and applied to Arrow batches of whole texts against a fixed threshold.

Defined results: a null or empty text has no words, counts of 0 and fails the base rules; repeated rows are scored
each on their own; an empty table gives an empty result; without usable labels of both classes every document that
passes the base rules is kept, with the labels' base rate as its probability. Columns other than the id and the text
are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import map_arrow

from . import common
from . import textkernel as tk

BITS = 18
MIN_WORDS = 50
SYMBOLS = tk.table(b"#*$%&|<>")
NOT_CONTINUED = tk.IS_START
CHAR_N = 3
#: Calibrated probability of good quality below which a document is not kept.
THRESHOLD = 0.5
MAX_TRAIN = 4096
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _tokens(buf, offs):
    starts, ends, row = tk.spans(buf, offs, tk.IS_WHITE)
    return starts, ends, row, tk.hash_spans(buf, starts, ends)


def base_counts(buf, offs, tokens) -> dict[str, np.ndarray]:
    """The base rules' counts of each row."""
    starts, ends, row, h = tokens
    n = len(offs) - 1
    count = lambda r: np.bincount(r, minlength=n).astype(np.int64)
    white = tk.IS_WHITE[buf] if len(buf) else np.zeros(0, bool)
    chars = tk.per_row(NOT_CONTINUED[buf] & ~white, offs)
    symbols = tk.per_row(SYMBOLS[buf], offs)
    ls, le, lr = tk.lines(buf, offs)
    has_word = np.searchsorted(starts, le, "left") > np.searchsorted(starts, ls, "left")
    ls, le, lr = ls[has_word], le[has_word], lr[has_word]
    dup, _ = tk.repeats(tk.hash_spans(buf, ls, le), lr)
    w, at = tk.windows(h, row, 3)
    _, twice = tk.repeats(w, row[at])
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    words, repeat = count(row), count(row[covered])
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": count(lr[dup]), "n_repeat_words": repeat, "base_failed": (words < MIN_WORDS) | (100 * repeat > 50 * words)}


def hashed(buf, offs, tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of hashed features, each as (index, row): words, word pairs, character n-grams."""
    starts, ends, row, h = tokens
    mask = np.uint64((1 << BITS) - 1)
    pair, at = tk.windows(h, row, 2, 1)
    cp = tk.code_points(buf)
    cp_row = np.searchsorted(offs, cp, "right") - 1
    k = len(cp) - CHAR_N
    if k >= 0 and len(cp):
        ends_at = np.concatenate((cp[CHAR_N:], [len(buf)]))
        first = cp[: k + 1]
        ok = cp_row[: k + 1] == cp_row[CHAR_N - 1 :]
        gram, gram_row = tk.hash_spans(buf, first[ok], ends_at[: k + 1][ok]), cp_row[: k + 1][ok]
        gram = tk.mix(gram ^ np.uint64(0x5BD1E995))
    else:
        gram, gram_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return [((h & mask).astype(np.int32), row), ((pair & mask).astype(np.int32), row[at]), ((gram & mask).astype(np.int32), gram_row)]


def _features(col):
    buf, offs = tk.load(col)
    n = len(offs) - 1
    groups = hashed(buf, offs, _tokens(buf, offs))
    idx, row, val = [], [], []
    for i, r in groups:
        size = np.maximum(np.bincount(r, minlength=n), 1)
        u, c, at = common.unique_per_row(i, r, n, BITS)
        rr = np.repeat(np.arange(n), np.diff(at))
        idx.append(u)
        row.append(rr)
        val.append(c / size[rr])
    idx, row, val = map(np.concatenate, (idx, row, val))
    order = np.argsort(row, kind="stable")
    return idx[order], val[order].astype(np.float32), np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)


def _fit(y, at, idx, val, epochs: int = 12, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over mini-batches."""
    rng = np.random.default_rng(7)
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4)
    b, gb = 0.0, 1e-4
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 16):
            part = order[i : i + 16]
            pick = np.concatenate([np.arange(at[j], at[j + 1]) for j in part])
            r = np.repeat(np.arange(len(part)), at[part + 1] - at[part])
            x, v = idx[pick], val[pick] * 8
            err = (common.sigmoid(np.bincount(r, w[x] * v, len(part)) + b) - y[part]) * balance[part]
            ux, inv = np.unique(x, return_inverse=True)
            g = np.bincount(inv, err[r] * v, len(ux)) / len(part)
            g2[ux] += g * g
            w[ux] -= rate * g / np.sqrt(g2[ux])
            eb = err.mean()
            gb += eb * eb
            b -= rate * eb / np.sqrt(gb)
    return w * 8, b


class QualityModel:
    """Weights, offset and calibration; ``score`` gives the calibrated probability of good quality of each row."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights.astype(np.float32), offset, slope, shift

    def logit(self, buf, offs, tokens) -> np.ndarray:
        n = len(offs) - 1
        z = np.full(n, self.offset)
        for i, r in hashed(buf, offs, tokens):
            z += np.bincount(r, self.weights[i], n) / np.maximum(np.bincount(r, minlength=n), 1)
        return self.slope * z + self.shift

    def score(self, buf, offs, tokens) -> np.ndarray:
        return common.sigmoid(self.logit(buf, offs, tokens))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_train: int = MAX_TRAIN) -> QualityModel:
    """Fit and calibrate on at most about ``max_train`` labelled rows."""
    sample = common.labelled_sample(labels, id_col, label_col, max_train)
    y, at, idx, val = common.csr(common.sparse_rows(sample, docs, id_col, text_col, _features))
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    held = np.arange(len(y)) % 5 == 0
    fit = np.flatnonzero(~held)
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
        held[:] = True
        fit = np.arange(len(y))
    sub_at = np.concatenate(([0], np.cumsum(at[fit + 1] - at[fit])))
    pick = np.concatenate([np.arange(at[j], at[j + 1]) for j in fit])
    w, b = _fit(y[fit], sub_at, idx[pick], val[pick])
    z = np.bincount(np.repeat(np.arange(len(y)), np.diff(at)), w[idx] * val, len(y)) + b
    slope, shift = common.platt(z[held], y[held])
    return QualityModel(w, b, max(slope, 0.0), shift)


def assess(docs: DataFrame, model: QualityModel, *, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, probability of good quality and the verdict of every document."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, text_col):
                buf, offs = tk.load(part.column(1))
                tokens = _tokens(buf, offs)
                out = base_counts(buf, offs, tokens)
                out["score"] = model.score(buf, offs, tokens)
                out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out.values())], names=[id_col, *out])

    return map_arrow(rows, run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {BASE}, score double, kept boolean")
