"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A document's evidence is the log-likelihood ratio of a logistic regression on counts of its whole text, fitted to a
bounded sample (``max_train``, expected) of labelled rows. A site name ``host/path...`` places it in a host and in a
path (host and first path segment). Grouped aggregation adds up the documents' probabilities for each path and host.
Rates are Beta-binomial posteriors: a path's rate is shrunk towards its host's, a host's towards the global one, each
by a strength that the method of moments gives from the spread between groups; a sparse site thus says little. A
document's own probability is taken out of its groups' sums before they judge it.

Site statistics are partially aggregated, so a host with a third of all rows is no burden; they are broadcast while
they are few (checked) and joined by a shuffle beyond that.

Defined results: a null or empty text has zero counts, which is evidence like any other; a null site is the host ""
with the path "/"; repeated rows are documents each; an empty table gives an empty result; without labels of both
classes the evidence is 0 and only the site rates (all equal then) remain. Columns named ``_ls_*`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from . import common, quality_rules
from . import textkernel as tk

MAX_TRAIN = 8192
THRESHOLD = 0.5
#: Bounds of a document's evidence and of what a site can add or take.
MOST_EVIDENCE, MOST_SITE = 8.0, 3.0
_UPPER = tk.table(bytes(range(0x41, 0x5B)))
_LOWER = tk.table(bytes(range(0x61, 0x7B)))
_DIGIT = tk.table(bytes(range(0x30, 0x3A)))
_MARKS = tk.table(b"!?")
_STOPS = tk.table(b".,;:")
N_FEATURES = 14


def features(col) -> np.ndarray:
    """Shares and logarithms of counts of each row."""
    buf, offs = tk.load(col)
    tokens = quality_rules._tokens(buf, offs)
    base = quality_rules.base_counts(buf, offs, tokens)
    per = lambda t: tk.per_row(t[buf], offs)
    words, chars = base["n_words"], np.maximum(base["word_chars"], 1)
    w = np.maximum(words, 1)
    up, low = per(_UPPER), per(_LOWER)
    return np.column_stack(
        [
            np.log1p(words), base["word_chars"] / w, np.minimum(base["n_symbols"] / w, 3), np.sqrt(base["n_symbols"] / chars), up / np.maximum(up + low, 1), np.sqrt(up / np.maximum(up + low, 1)), per(_DIGIT) / chars,
            np.minimum(per(_MARKS) / w, 2), per(_STOPS) / w, base["n_dup_lines"] / np.maximum(per(tk.table(b"\n")) + 1, 1), base["n_repeat_words"] / w, per(~tk.IS_START) / chars, (words == 0).astype(float), np.minimum(per(tk.table(b"|")) / w, 2),
        ]
    )


class Evidence:
    """A logistic regression on standardised features; ``ratio`` gives log-likelihood ratios."""

    def __init__(self, mean=None, scale=None, weight=None, offset=0.0, prior=0.0):
        self.mean, self.scale, self.weight, self.offset, self.prior = mean, scale, weight, offset, prior

    def ratio(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.zeros(len(x))
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.offset
        return np.clip(z - self.prior, -MOST_EVIDENCE, MOST_EVIDENCE)


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", max_train: int = MAX_TRAIN) -> Evidence:
    """Fit on at most about ``max_train`` labelled rows (ridge-penalised Newton steps)."""
    sample = common.labelled_sample(labels, id_col, label_col, max_train)

    def rows(col):
        x = features(col)
        n, k = x.shape
        return np.tile(np.arange(k), n), x.ravel(), np.arange(n + 1) * k

    y, _, _, val = common.csr(common.sparse_rows(sample, docs, id_col, text_col, rows))
    if len(y) == 0 or y.min() == y.max():
        return Evidence()
    x = val.astype(float).reshape(len(y), N_FEATURES)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(y))])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.5] * (a.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = common.sigmoid(a @ w)
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return Evidence(mean, scale, w[:-1], float(w[-1]), float(np.log(y.mean() / (1 - y.mean()))))


def with_evidence(docs: DataFrame, model: Evidence, site: Column, *, text_col="text") -> DataFrame:
    """All columns of ``docs`` and ``_ls_ratio``, ``_ls_host``, ``_ls_path``."""
    site = F.coalesce(site.cast("string"), F.lit(""))
    host = F.substring_index(site, "/", 1)
    path = F.concat(host, F.lit("/"), F.coalesce(F.get(F.split(site, "/"), F.lit(1)), F.lit("")))
    rows = docs.select("*", host.alias("_ls_host"), path.alias("_ls_path"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in tk.slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.ratio(features(part.column(at))))], names=[*part.schema.names, "_ls_ratio"])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField("_ls_ratio", T.DoubleType())]))


def _strength(spread: float | None, chance: float | None, room: float | None, variance: float) -> float:
    """Prior strength of Beta-binomial rates by the method of moments: variance / between - 1.

    ``spread`` is the sum of squared deviations of group rates from their parents', weighted by group size, ``chance`` the
    part of it that chance explains, ``room`` what a between-group variance of 1 would add, ``variance`` the mean of
    rate * (1 - rate). Kept from 2 to 10,000, so that groups that differ by no more than chance are shrunk firmly."""
    between = ((spread or 0.0) - (chance or 0.0)) / room if room else 0.0
    return min(max(variance / between - 1, 2.0), 1e4) if between > 0 else 1e4


def site_rates(scored: DataFrame) -> DataFrame:
    """For each path (``_ls_path``): its own and its host's counts, the global rate and the strengths, from
    ``with_evidence`` rows. The global rate and the two strengths are three numbers that the driver reads from grouped sums."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_ls_ratio")))
    paths = scored.groupBy("_ls_host", "_ls_path").agg(F.count("*").alias("_ls_n_path"), F.sum(p).alias("_ls_k_path"))
    paths = common.checkpointed(paths)
    hosts = paths.groupBy("_ls_host").agg(
        F.sum("_ls_n_path").alias("_ls_n_host"), F.sum("_ls_k_path").alias("_ls_k_host"), F.count("*").alias("_ls_g"), F.sum(F.pow(F.col("_ls_n_path").cast("double"), 2)).alias("_ls_sq")
    )
    hosts = common.checkpointed(hosts)
    all_ = hosts.agg(F.sum("_ls_n_host").alias("n"), F.sum("_ls_k_host").alias("k"), F.count("*").alias("g"), F.sum(F.pow(F.col("_ls_n_host").cast("double"), 2)).alias("sq")).first()
    n, rate = all_["n"] or 0, ((all_["k"] or 0.0) + 1) / ((all_["n"] or 0) + 2)
    own = F.col("_ls_k_host") / F.col("_ls_n_host")
    off = hosts.agg(
        F.sum(F.col("_ls_n_host") * F.pow(own - rate, 2)).alias("s"), F.sum(F.col("_ls_n_host") * own * (1 - own)).alias("v"),
        F.sum((F.col("_ls_g") - 1) * own * (1 - own)).alias("e"), F.sum(F.col("_ls_n_host") - F.col("_ls_sq") / F.col("_ls_n_host")).alias("room"),
    ).first()
    host_strength = _strength(off["s"], (all_["g"] - 1) * rate * (1 - rate), n - all_["sq"] / n if n else 0, rate * (1 - rate))
    joined = paths.join(hosts, "_ls_host").withColumn("_r", F.col("_ls_k_host") / F.col("_ls_n_host"))
    spread = joined.agg(F.sum(F.col("_ls_n_path") * F.pow(F.col("_ls_k_path") / F.col("_ls_n_path") - F.col("_r"), 2)).alias("s")).first()["s"]
    path_strength = _strength(spread, off["e"], off["room"], (off["v"] or 0.0) / n if n else 0.25)
    joined = joined.select("_ls_path", "_ls_n_path", "_ls_k_path", "_ls_n_host", "_ls_k_host")
    return joined.select("*", F.lit(rate).alias("_ls_rate"), F.lit(host_strength).alias("_ls_host_strength"), F.lit(path_strength).alias("_ls_path_strength"))


def judged(docs: DataFrame, model: Evidence, site: Column, *, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``_ls_host``, ``_ls_path``, ``_ls_ratio``, ``_ls_host_rate``, ``_ls_path_rate``,
    ``_ls_score`` and ``_ls_kept``."""
    rates = common.checkpointed(site_rates(with_evidence(docs.select(text_col, site.alias("_ls_site")), model, F.col("_ls_site"), text_col=text_col)))
    if rates.count() * 200 <= common.BROADCAST_LIMIT:
        rates = F.broadcast(rates)
    c = F.col
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-c("_ls_ratio")))
    # the document's own part is taken out of both levels
    host = (c("_ls_k_host") - p + c("_ls_host_strength") * c("_ls_rate")) / (c("_ls_n_host") - 1 + c("_ls_host_strength"))
    path = (c("_ls_k_path") - p + c("_ls_path_strength") * c("_ls_host_rate")) / (c("_ls_n_path") - 1 + c("_ls_path_strength"))
    logit = lambda x: F.log(x / (1 - x))
    bounded = lambda x, b: F.least(F.greatest(x, F.lit(-b)), F.lit(b))
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = with_evidence(docs, model, site, text_col=text_col).join(rates, "_ls_path")
    out = out.withColumn("_ls_host_rate", clip(host)).withColumn("_ls_path_rate", clip(path))
    z = c("_ls_ratio") + bounded(logit(c("_ls_path_rate")), MOST_SITE)
    out = out.withColumn("_ls_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).withColumn("_ls_kept", c("_ls_score") >= threshold)
    return out.drop("_ls_n_path", "_ls_k_path", "_ls_n_host", "_ls_k_host", "_ls_rate", "_ls_host_strength", "_ls_path_strength")


def kept(docs: DataFrame, model: Evidence, site: Column, **kw) -> DataFrame:
    """The documents that are not rejected, with their columns as they were."""
    return judged(docs, model, site, **kw).where("_ls_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
