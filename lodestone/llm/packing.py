"""Packing by cutting-stock column generation.

Documents become token ids (their own, then an end id). What fills whole sequences is cut off as such; what remains
of a document is at most one shorter piece. Its length, rounded up to units of ``unit`` tokens, puts it into one of
``capacity / unit`` classes. The histogram of the classes is a cutting-stock problem: a linear program over patterns
(how many pieces of each class share a sequence), whose columns an unbounded knapsack prices by dynamic programming
until none improves it. Pattern counts are rounded down and the few pieces left over are packed by best fit on the
histogram. Patterns are then assigned to documents by their rank within the class: the driver only ever holds the
histogram and the patterns, whose sizes depend on the capacity and the unit alone.

Ranks come from counts per (input partition, class) and a window over those counts, so no class is sorted or gathered
in one task. Offsets inside a sequence come from a window over its pieces (at most ``capacity`` of them).

Defined results: a null or empty text is the end id alone; repeated rows, also with equal or null ids, are documents
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import warnings
import zlib
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow

from . import common

CAPACITY = 4096
UNIT = 8
END_ID = 2
#: Distinct words whose ids a Python worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 700_000


class Encoder:
    """Token ids of texts by a file of the tokenizers library.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its parts between
    spaces and newlines, one after another. Parts repeat a lot; their ids are kept.
    """

    def __init__(self, path: str):
        self.path, self._tok = path, None

    def _open(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(self.path)
        vocab = self._tok.get_vocab()
        #: Which ids end a unit, in vocabularies that mark it.
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self):
        self._known: dict[str, int] = {"": 0}
        self._flat, self._at, self._n, self._end = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 1, 0

    def _put(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember the ids of new words; the arrays double when full."""
        n, end = self._n + len(words), self._end + len(ids)
        while len(self._flat) < end:
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        while len(self._at) <= n:
            self._at = np.concatenate((self._at, np.zeros_like(self._at)))
        self._flat[self._end : end] = ids
        self._at[self._n + 1 : n + 1] = self._end + np.cumsum(size)
        self._known.update(zip(words, range(self._n, n)))
        self._n, self._end = n, end

    def _encode_each(self, words: list[str]) -> None:
        got = [e.ids for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        self._put(words, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size)

    def _learn(self, new: set[str]) -> None:
        """Ids of words not met before. Words of letters alone are one unit each to the tokenizer, so many are encoded
        as one text; a full stop or comma after letters is a unit of its own."""
        letters = lambda w: w.isalpha() and (w.isascii() or w.lower().isalpha())
        pure = {w for w in new if letters(w)}
        marked = [w for w in new if w[-1] in ".," and letters(w[:-1])]
        self._encode_each(list(new.difference(pure, marked).union(".,").difference(self._known)))
        pure = list(pure.union(w[:-1] for w in marked).difference(self._known))
        for i in range(0, len(pure), 2000):
            part = pure[i : i + 2000]
            ids = np.array(self._tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self._ends[ids])
            if len(last) == len(part) and last[-1] == len(ids) - 1:
                self._put(part, ids, np.diff(np.concatenate(([-1], last))))
            else:
                self._encode_each(part)
        if marked:
            base = np.fromiter((self._known[w[:-1]] for w in marked), np.int64, len(marked))
            mark = np.fromiter((self._known[w[-1]] for w in marked), np.int64, len(marked))
            word = np.column_stack((base, mark)).ravel()
            ids, to = self._gather(word)
            self._put(marked, ids, np.diff(np.concatenate(([0], to[1::2]))))

    def _gather(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words one after another, and where each ends."""
        first = self._at[word]
        size = self._at[word + 1] - first
        to = np.cumsum(size)
        return self._flat[np.repeat(first - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)], to

    @staticmethod
    def _plain(text: str) -> str:
        """The text in lower case where the tokenizer, which lower-cases, gives the same ids for both."""
        if text.isascii():
            return text if "<|" in text else text.lower()
        return text if "<|" in text or "\u03a3" in text or "\u0130" in text or not is_normalized("NFC", text) else text.lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the texts."""
        if self._tok is None:
            self._open()
        if len(self._known) > CACHE_WORDS:
            self._reset()
        parts = [self._plain(t).replace("\n", " ").split(" ") for t in texts]
        if new := set().union(*parts).difference(self._known):
            self._learn(new)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.fromiter(map(self._known.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        flat, to = self._gather(word)
        return flat, np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(n)))]


def pieces(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens. All but a document's last piece are full."""
    rows = docs.select(id_col, text_col)

    def run(batches):
        from ..shipping import keep
        from . import packing
        from . import textkernel as tk

        # kept by the worker from task to task
        encoder = keep(f"encoder {tokenizer}", lambda: packing.Encoder(tokenizer))

        for batch in batches:
            for part in tk.slices(batch, text_col, 1 << 20):
                flat, at = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                flat = flat.astype("<u4")
                out = []
                for d in range(part.num_rows):
                    ids = np.append(flat[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    out += [(d, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(cols[0]), *cols[1:]], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(rows, run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long", keeps=f"encoder {tokenizer}")


#: How much the best prices so far weigh in those that patterns are priced at.
HOLD = 0.7


def _knapsack(price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack of classes 1..len(price): the most value within each room, and the class to take last (0: none)."""
    value, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    size = np.flatnonzero(price > 0) + 1
    worth = price[size - 1]
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        k = int(np.searchsorted(size, c, "right"))
        if k:
            total = worth[:k] + value[c - size[:k]]
            i = int(total.argmax())
            if total[i] > value[c] + 1e-12:
                value[c], last[c] = total[i], size[i]
    return value, last


def _traced(last: np.ndarray, c: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    while c > 0:
        if last[c] == 0:
            c -= 1
        else:
            out[last[c] - 1] += 1
            c -= last[c]
    return out


def best_pattern(price: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..len(price) within ``room`` units."""
    value, last = _knapsack(price, room)
    return float(value[room]), _traced(last, room, len(price))


def _first_patterns(size: np.ndarray, demand: np.ndarray, room: int) -> list[np.ndarray]:
    """A pattern for each class, from the largest: the class as often as it fits, then the largest that still fit of what
    is left. No pattern holds a larger class, so they are a basis, and none uses more than is there, so it is feasible."""
    left, out = demand.copy(), [None] * len(size)
    for i in range(len(size) - 1, -1, -1):
        column = np.zeros(len(size), np.int64)
        column[i] = room // size[i]
        free, times = room - column[i] * size[i], max(left[i], 0.0) / column[i]
        for j in range(i - 1, -1, -1):
            if free < size[0] or times <= 0:
                break
            column[j] = min(free // size[j], int(max(left[j], 0.0) / times))
            free -= column[j] * size[j]
        left -= times * column
        out[i] = column
    return out


def _triangular_inverse(upper: np.ndarray) -> np.ndarray:
    """Inverse of an upper triangular matrix, from its last row up. LAPACK's threaded factorisation is avoided: in a
    process that started Spark's JVM, its thread pool can wait for ever."""
    out = np.zeros_like(upper)
    for i in range(len(upper) - 1, -1, -1):
        out[i] = -(upper[i, i + 1 :] @ out[i + 1 :])
        out[i, i] += 1
        out[i] /= upper[i, i]
    return out


def column_generation(demand: np.ndarray, room: int, gap: float = 5e-4, rounds: int = 2000) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Patterns over the classes in demand, how often the linear program uses each, and prices of all classes.

    Revised simplex on: minimise the number of sequences, each class covered. Starts from greedy patterns. No
    pattern is worth more than 1 at the prices returned, so what the demand is worth at them bounds any packing from
    below; the first such prices are the classes' shares of a sequence, rounded up to 1 for those that leave room only for
    pieces below a size, which are then free (the size that bounds best is taken). Patterns are priced between the best prices so
    far and the simplex's own, which keeps these from swinging. Rounds end when the program is within a quarter of a
    sequence, or a share ``gap``, of the bound; a warning names the gap where they don't. The demand is perturbed slightly
    while the simplex runs, so that ties can't make it cycle.
    """
    classes = np.flatnonzero(demand)
    d = demand[classes].astype(float)
    n = len(classes)
    shaken = d + np.random.default_rng(1).uniform(1e-5, 2e-5, n) * max(1.0, d.max(initial=1.0))
    columns = _first_patterns(classes + 1, shaken, room)
    inverse = _triangular_inverse(np.column_stack(columns).astype(float)) if n else np.zeros((0, 0))
    size = np.arange(1, len(demand) + 1)
    first = [np.where(size > room - t, 1.0, np.where(size >= t, size / room, 0.0)) for t in range(room // 2 + 1)]
    best = max(first, key=lambda price: float(price @ demand))
    bound, pivots, x = float(best @ demand), 0, inverse @ shaken
    hold, last = HOLD, np.inf
    for _ in range(rounds):
        own = np.zeros(len(demand))
        own[classes] = np.maximum(inverse.sum(axis=0), 0)
        need = float(np.maximum(inverse @ d, 0).sum())
        if need - bound <= max(0.25, gap * need):
            break
        price = hold * best + (1 - hold) * own
        gain, pattern = best_pattern(price, room)
        gain = max(1.0, gain)
        if (low := float(price @ demand) / gain) > bound:
            best, bound = price / gain, low
        column = pattern[classes]
        if own[classes] @ column <= 1 + 1e-7:  # no gain for the simplex: price nearer to it
            if hold == 0:
                break
            hold = hold / 2 if hold > 0.02 else 0.0
            continue
        hold = HOLD if need < last - 1e-4 else hold / 2
        last = min(last, need)
        step = inverse @ column
        ratio = np.where(step > 1e-7, x / np.where(step > 1e-7, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[out] = column
        pivots += 1
        if pivots % 64 == 0:  # a Newton step against rounding that adds up
            inverse = 2 * inverse - inverse @ (np.column_stack(columns) @ inverse)
        x = np.maximum(inverse @ shaken, 0)
    else:
        warnings.warn(f"packing: the linear program stopped {need - bound:.2f} sequences above its bound of {bound:.2f}")
    return columns, np.maximum(inverse @ d, 0), best


def cutting_stock(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that exactly ``demand[c-1]`` pieces of c units are placed."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    columns, x, _ = column_generation(demand, room)
    left, plan = demand.copy(), []
    for i in np.argsort(-x, kind="stable"):
        full = np.zeros(len(demand), np.int64)
        full[classes] = columns[i]
        have = full > 0
        times = min([int(x[i] + 1e-9), *(left[have] // full[have])]) if have.any() else 0
        if times > 0:
            plan.append((full, int(times)))
            left -= times * full
    return plan + best_fit(left, room)


def best_fit(left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """The pieces that rounding leaves over: the largest that still fits, again and again, over the histogram."""
    left, plan = left.copy(), []
    while left.any():
        pattern, free = np.zeros(len(left), np.int64), room
        for c in range(len(left), 0, -1):
            k = min(int(left[c - 1]), free // c)
            pattern[c - 1] = k
            free -= k * c
        times = int(min(left[pattern > 0] // pattern[pattern > 0]))
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def pack(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Pieces with their place: ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    made = common.checkpointed(
        pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)
        .withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    room = capacity // unit
    count = made.groupBy("_pid", "_class").agg(F.count("*").alias("n"))
    demand = np.zeros(room, np.int64)
    for r in count.groupBy("_class").agg(F.sum("n").alias("n")).collect():
        demand[r["_class"] - 1] = r["n"]

    # where the ranks of a class go: from rank `first` on, `each` to a sequence, beginning with sequence `base`
    slots, base, used = [], 0, np.zeros(room, np.int64)
    for pattern, times in cutting_stock(demand, room):
        for c in np.flatnonzero(pattern):
            slots.append((int(c) + 1, int(used[c]), int(used[c] + pattern[c] * times), int(pattern[c]), base))
            used[c] += pattern[c] * times
        base += times
    slot = spark.createDataFrame(slots, "_class int, _first long, _end long, _each long, _base long")
    runs = slot.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("_first", "_end", "_each", "_base"))).alias("_runs"))

    before = count.select("_pid", "_class", (F.sum("n").over(Window.partitionBy("_class").orderBy("_pid")) - F.col("n")).alias("_before"))
    inside = Window.partitionBy("_pid", "_class").orderBy("_at")
    ranked = made.withColumn("_nth", F.row_number().over(inside) - 1).join(before, ["_pid", "_class"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    # slots of all classes together are bounded by capacity / unit patterns of as many classes
    at = ranked.join(F.broadcast(runs), "_class").withColumn("_run", F.filter("_runs", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_end"]))[0])
    at = at.withColumn("sequence_id", F.col("_run._base") + F.floor((F.col("_rank") - F.col("_run._first")) / F.col("_run._each")))
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_at")
    return at.withColumn("offset", F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")).select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
