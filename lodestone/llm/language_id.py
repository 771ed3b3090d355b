"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

Each language has a raw-content dictionary of ``DICT_BYTES`` bytes, put together from passages of a bounded sample of
its documents (``docs_per_lang``, expected). A passage begins at a place that a hash chooses in the whole text, and goes
on at the text's start where it ends. Passages are short where there are many documents, and longer, up to whole texts,
until the dictionary is full where there are few. A language with less text than that has a smaller dictionary, which
changes no other one: only in comparisons with it are the larger dictionaries cut to about its size (to its step, at
most 19 % above it, and never below ``LEAST``).

A text is lower-cased, every run of other characters than letters becomes one space, and it is cut into pieces of
``PIECE`` bytes that cover it whole; every piece is compressed on its own with each dictionary, and the language with
the smallest sum is chosen, from the largest dictionaries to the smallest: one with a smaller dictionary is chosen if
no larger one, cut to its size, has a smaller sum, and it saves at least half of what the best larger one saves whole
(else noise in short texts would choose dictionaries that hold next to nothing). The margin is the least share by
which another language's sum is larger; below ``min_margin`` the operator's ``lang`` is null (rejected) while ``best``
still names the smallest.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal sums go to the language with
the most documents, then to the one that sorts first; languages with no sampled text are not learned; with none learned every text is ``und``. An empty table
gives an empty result, and repeated rows are classified each on their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow

from . import common

DICT_BYTES = 96 << 10
PIECE = 2048
LEVEL = 6
#: Dictionaries below this many bytes are compared with others of this size: so little text proves little.
LEAST = 4096
#: Compressors of cut dictionaries that a model keeps.
KEPT = 64
DOCS_PER_LANG = 400
#: A language with fewer sampled passages keeps them all: their halves say too little to judge each other.
FEW = 8
#: Languages learned: those with the most documents that aren't held out.
MAX_LANGS = 512
MIN_MARGIN = 0.01
_WORD = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def held_out(col):
    """Rows that learning never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(col.cast("string").cast("binary")) % 4 == 2


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in the text (other numerals, as in fractions, are no letters)."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def _plain(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def _step(size: int) -> int:
    """The size at which a dictionary is compared with larger ones: four steps for each doubling, rounded up."""
    step = DICT_BYTES
    for k in range(1, 64):
        lower = int(DICT_BYTES / 2 ** (k / 4))
        if lower < max(size, LEAST):
            break
        step = lower
    return step


def _turned(text, key, passage: int):
    """A text from a place that the key's hash chooses, and from its start when it has ended."""
    start = F.pmod(F.xxhash64(F.lit("place"), key), F.greatest(F.length(text) - passage + 1, F.lit(1))).cast("int")
    return F.when(start > 0, F.concat(F.substring(text, start + 1, F.length(text)), F.lit(" "), F.substring(text, F.lit(1), start))).otherwise(text)


class LanguageModel:
    """Dictionaries by language; ``classify`` returns (best, score, margin) for a text."""

    def __init__(self, dictionaries: dict[str, bytes], counts: dict[str, int] | None = None):
        self.dictionaries = dict(sorted(dictionaries.items(), key=lambda x: (-(counts or {}).get(x[0], 0), x[0])))
        self.steps = [_step(len(x)) for x in self.dictionaries.values()]
        self._compressors, self._cut = None, {}

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "steps": self.steps, "_compressors": None, "_cut": {}}

    @staticmethod
    def _make(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _made(self):
        if self._compressors is None:
            self._compressors = [self._make(raw) for raw in self.dictionaries.values()]
        return self._compressors

    def _made_cut(self, i: int, step: int):
        got = self._cut.pop((i, step), None)
        if got is None:
            got = self._make(list(self.dictionaries.values())[i][-step:] if step else b" " * 8)
            while len(self._cut) >= KEPT:
                del self._cut[next(iter(self._cut))]
        self._cut[i, step] = got
        return got

    def classify(self, text: str | None) -> tuple[str, float, float]:
        if text is None or not self.dictionaries or not has_letter(text):
            return "und", 0.0, 0.0
        names = list(self.dictionaries)
        if len(names) == 1:
            return names[0], 1.0, 1.0
        raw = _plain(text)
        pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        own = [sum(len(c.compress(x)) for x in pieces) for c in self._made()]
        seen: dict[tuple[int, int], int] = {}

        def size(i: int, step: int) -> int:
            """The sum of a language with its dictionary cut to a step."""
            if self.steps[i] <= step:
                return own[i]
            if (i, step) not in seen:
                c = self._made_cut(i, step)
                seen[i, step] = sum(len(c.compress(x)) for x in pieces)
            return seen[i, step]

        blank = sum(len(self._made_cut(-1, 0).compress(x)) for x in pieces) if len(set(self.steps)) > 1 else 0

        def weak(i: int, large: int) -> bool:
            """Whether a smaller dictionary saves nothing, or less than half of what a larger whole one does."""
            return own[i] >= blank or 2 * (blank - own[i]) < blank - own[large]

        best = None
        for step in sorted(set(self.steps), reverse=True):
            i = min((i for i, s in enumerate(self.steps) if s == step), key=lambda i: (own[i], i))
            if best is None or not weak(i, best) and (own[i], i) < (size(best, step), best) and all((own[i], i) < (size(j, step), j) for j, s in enumerate(self.steps) if s > step):
                best = i
        margin, p = 1.0, 1.0
        for i, s in enumerate(self.steps):
            if i != best:
                common = DICT_BYTES if s < self.steps[best] and weak(i, best) else min(s, self.steps[best])
                a, b = size(best, common), size(i, common)
                margin = min(margin, (b - a) / max(b, 1))
                p += float(np.exp(-max(b - a, 0) / max(a, 1) * 25))
        return names[best], 1 / p, max(margin, 0.0)


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", docs_per_lang: int = DOCS_PER_LANG, max_langs: int = MAX_LANGS) -> LanguageModel:
    """Dictionaries from at most about ``docs_per_lang`` documents of each language that aren't held out.

    The share taken of each language follows from its count, so that a language with most of the rows is sampled where
    it lies and never gathered. Only the passages (bounded by the dictionary's size) reach the driver: they are as long
    as it takes for the sample to hold some four times the dictionary's size, if it does.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(~held_out(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (F.length("_text") > 0))
    passage = max(256, 2 * DICT_BYTES // docs_per_lang)
    tops = [4 * passage]
    while tops[-1] < 4 * DICT_BYTES:
        tops.append(2 * tops[-1])
    found = usable.groupBy("_lang").agg(F.count("*").alias("n"), *[F.sum(F.least(F.length("_text"), F.lit(t))).alias(f"t{t}") for t in tops]).orderBy(F.desc("n"), "_lang").limit(max_langs).collect()
    found = [r.asDict() | {"_lang": str(r["_lang"])} for r in found]
    counts = {r["_lang"]: r["n"] for r in found}
    if not counts:
        return LanguageModel({})
    part = {r["_lang"]: min(1.0, docs_per_lang / r["n"]) for r in found}
    top = {r["_lang"]: next((t for t in tops if r[f"t{t}"] * part[r["_lang"]] >= 4 * DICT_BYTES), tops[-1]) for r in found}
    plan = docs.sparkSession.createDataFrame([(k, int((1 << 30) * v), top[k]) for k, v in part.items()], "_lang string, _share long, _take int")
    usable = usable.withColumn("_lang", F.col("_lang").cast("string")).join(F.broadcast(plan), "_lang")
    taken = F.substring(_turned(F.col("_text"), F.col("_id"), passage), F.lit(1), F.col("_take"))
    # rows that repeat an id and its text count once
    picked = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("_share")).select("_id", "_lang", taken.alias("_text"), F.xxhash64("_id").alias("_h")).distinct()
    own: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["_lang"], r["_h"], str(r["_id"]), r["_text"])):
        own.setdefault(r["_lang"], []).append(_plain(r["_text"]))
    # a half's dictionaries judge the other half's passages; those that look like another language stay out
    halves = [LanguageModel(_dictionaries({k: v[i::2] for k, v in own.items() if len(v) > 1})) for i in (1, 0)]
    clean = {}
    for lang, texts in own.items():
        good = [t for i, t in enumerate(texts) if len(texts) < FEW or halves[i % 2].classify(t.decode(errors="ignore"))[0] == lang]
        clean[lang] = good if 2 * len(good) >= len(texts) else texts
    return LanguageModel(_dictionaries(clean), counts)


def _dictionaries(passages: dict[str, list[bytes]]) -> dict[str, bytes]:
    """Raw dictionaries: the same share of every passage, then more of the longer ones until the dictionary is full."""
    out = {}
    for lang, texts in passages.items():
        at = step = max(64, DICT_BYTES // len(texts))
        raw = b" ".join(t[:at] for t in texts)
        while len(raw) < DICT_BYTES and (more := [t[at : at + step] for t in texts if len(t) > at]):
            raw = b" ".join([*more, raw])
            at, step = at + step, 2 * step
        out[lang] = raw[-DICT_BYTES:].rjust(8)
    return out


def identify(docs: DataFrame, model: LanguageModel, *, id_col="doc_id", text_col="text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """For every document: ``lang`` (null where the margin is narrow), ``best``, ``score``, ``margin``."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        for batch in batches:
            got = [model.classify(t.as_py()) for t in batch.column(1)]
            best, score, margin = ([x[i] for x in got] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b if b == "und" or m >= min_margin else None for b, m in zip(best, margin)], pa.string()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
                names=[id_col, "lang", "best", "score", "margin"],
            )

    return map_arrow(rows, run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, lang string, best string, score double, margin double")
