"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` consecutive words (an item of fewer words, but not none, is one window).
A window is the set of its shingles of up to three words. Since it must be contained in a document whole, one shingle
is a sufficient prefix: shingles are ordered by rarity, counted over all documents, and only the rarest of each
window is joined. A match gives the window's only possible place; positional and length bounds (the window must lie
inside the document) come first, then exact equality of the item-sized slice of words.

Both joins are against tables made from the benchmark alone. They are broadcast while the benchmark has at most
``broadcast_windows`` windows of a bounded number of bytes and shuffled beyond that, when a filter of 8 MB first leaves
out positions whose shingle is in no window; the result is the same. Documents are read
twice, once to count and once to match; only hits, and one row for each document, are shuffled. No text is.

Defined results: a null or empty text has no words and no hit; an item without words has no window; repeated item
rows count once; repeated documents give a row each; with an empty benchmark nothing is hit; ids of any type are
kept, null ids too (a null item id is left out of the lists); extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000
MARKS = 4096
#: Words of 64 bits in the token filter of a shuffled match, as a power of two.
FILTER_BITS = 20
#: ASCII other than digits and lower-case letters, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: lower-cased (A-Z only) runs of digits, a-z and non-ASCII characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() changes other letters too, so it serves where there are none
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _shingle(w: Column, at: Column, k: int) -> Column:
    """Hash of k words from a position on (null words at the end are skipped)."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(k)], F.lit(k))


def windows(benchmark: DataFrame, *, item_col="item_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: ``win`` (its words), ``len``, and ``items``, the sorted ids as strings."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    runs = items.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("at"))
    return (
        runs.select("item", F.slice("w", F.col("at"), F.least(F.lit(window), F.size("w"))).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("len", F.size("win"))
    )


def _mark(number: Column) -> Column:
    """The word that marks a document itself: a space, which no word has, and one of ``MARKS`` numbers, so that
    documents that are shuffled meet in as many tasks."""
    return F.concat(F.lit(" "), F.pmod(number, F.lit(MARKS)).cast("string"))


def _in_filter(tokens: DataFrame) -> Column:
    """Whether ``token`` may be in a table of tokens: a bit for each hash among 2^26 of them, 8 MB whatever the table's
    size, made by aggregation and read as a scalar subquery. False positives only cost the rows that a join drops."""
    place, bit = F.shiftrightunsigned("token", 64 - FILTER_BITS), F.shiftrightunsigned("token", 32).bitwiseAND(F.lit(63)).cast("int")
    held = tokens.groupBy(place.alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(token, 32) & 63 as int))")).alias("bits"))
    all_ = tokens.sparkSession.range(1 << FILTER_BITS).join(held, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bits = all_.agg(F.array_sort(F.collect_list("x")).alias("x")).select("x.bits").scalar()
    return F.getbit(F.get(bits, place.cast("int")), bit) == 1


def _positions(docs: DataFrame, sizes: list[int], carry: list[str], mark: Column) -> DataFrame:
    """A row for each word of each document with the hashes of the shingles that start there, and a last row whose
    word is the document's mark."""
    base = docs.select(*carry, F.concat(words(F.col("_text")), F.array(mark)).alias("w"))
    at = base.select(*carry, "w", F.posexplode("w").alias("at", "_word"))
    one = [_shingle(F.col("w"), F.col("at"), k) for k in sizes]
    return at.select(*carry, "w", "at", (F.explode(F.array(*one)) if len(one) > 1 else one[0]).alias("token"))


def match(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For every document: ``n_words``, ``spans`` (start and length of each window found, sorted) and ``items``
    (sorted ids of the items with a window in it), with the row's own number ``_row``."""
    from .common import BROADCAST_LIMIT, checkpointed

    wins = checkpointed(windows(benchmark, item_col=item_col, text_col=item_text_col, window=window).withColumn("wid", F.monotonically_increasing_id()))
    size = wins.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 8 * F.size("items") + 256).alias("bytes")).first()
    few = size["n"] <= broadcast_windows and (size["bytes"] or 0) <= BROADCAST_LIMIT
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    sizes = [r[0] for r in wins.select(F.least("len", F.lit(shingle)).alias("k")).distinct().orderBy("k").collect()] or [shingle]
    k_of = F.least(F.col("len"), F.lit(shingle))

    # every shingle of every window, and how often it stands in the documents
    inner = wins.select("wid", "win", "len", F.explode(F.sequence(F.lit(0), F.col("len") - k_of)).alias("off"))
    token = F.coalesce(*[F.when(k_of == k, _shingle(F.col("win"), F.col("off"), k)) for k in sizes])
    inner = inner.select("wid", "off", token.alias("token"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = _positions(rows, sizes, [], F.lit(" ")).select("token")
    if not few:
        counted = counted.where(_in_filter(inner.select("token")))
    counts = counted.join(small(inner.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        inner.join(counts, "token", "left")
        .groupBy("wid")
        .agg(F.min_by(F.struct("token", "off"), F.struct(F.coalesce("n", F.lit(0)), "off")).alias("best"))
        .select("wid", "best.token", "best.off")
    )
    mark = _shingle(F.array(_mark(F.col("id"))), F.lit(0), sizes[0])
    # every shingle size gives a document's mark another hash; that of the first size is used
    index = rarest.join(wins, "wid").select("token", "off", "len", "win", "items")
    index = index.unionByName(docs.sparkSession.range(MARKS).select(mark.alias("token"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.array().cast("array<string>").alias("items")))

    index = checkpointed(index)
    at = _positions(rows, sizes, ["_row", "_id"], _mark(F.xxhash64("_row"))).withColumn("n_words", F.size("w") - 1)
    if not few:  # rows that are shuffled may match, and carry the words that a window can reach, not the document
        at = at.where(_in_filter(index.select("token")))
        first = F.greatest(F.col("at") - (window - 1), F.lit(0))
        at = at.withColumn("first", first).withColumn("w", F.slice("w", F.col("first") + 1, F.lit(2 * window - 1)))
    else:
        at = at.withColumn("first", F.lit(0))
    p, i = at.alias("p"), index.alias("i")
    start = F.col("p.at") - F.col("i.off")
    n_words = F.col("p.n_words")
    holds = (start >= 0) & (start + F.col("i.len") <= n_words) & ((F.col("i.len") == 0) & (F.col("p.at") == n_words) | (F.slice("p.w", start - F.col("p.first") + 1, F.col("i.len")) == F.col("i.win")) & (F.col("i.len") > 0))
    hits = p.join(small(i), (F.col("p.token") == F.col("i.token")) & holds).select("_row", "_id", n_words.cast("long").alias("n_words"), F.when(F.col("i.len") > 0, F.struct(start.alias("start"), F.col("i.len").alias("len"))).alias("span"), F.col("i.items").alias("items"))
    return hits.groupBy("_row").agg(
        F.first("_id").alias(id_col), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def n_hit(spans: Column) -> Column:
    """Number of words that lie in at least one of the sorted spans."""
    add = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["start"] + s["len"]).alias("to")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), add)["n"].cast("long")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The documents without a hit, with all their columns. Rows that share an id stay or go together."""
    from .common import BROADCAST_LIMIT, checkpointed

    bad = match(docs, benchmark, id_col=id_col, text_col=text_col, **kw).where(F.size("spans") > 0)
    bad = checkpointed(bad.select(F.col(id_col).alias("_ls_bad_id")).distinct())
    if bad.count() * 64 <= BROADCAST_LIMIT:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_ls_bad_id")), "left_anti")
