"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

EXTRA = ("id", "key", "n", "score", "kept_text", "n_dropped", "comp", "hi", "token", "row", "n_lines", "rate", "n_path", "k_path", "n_host", "k_host", "host_strength", "path_strength", "set", "sig", "salt", "w", "at", "span", "items", "best", "margin", "length", "offset", "moved", "a", "b", "keys", "rep")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use for their own columns
    + [T.StructField(n, T.StringType()) for n in EXTRA]
)


def rows(texts):
    """(doc_id, text) pairs to full rows."""
    return [(i, t, "en" if i is None or i % 3 else None, None if i is not None and i % 7 == 0 else f"src{(i or 0) % 3}", None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(seed=1, n=60):
    """Texts over few words and lines, so that much repeats."""
    g = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Übung", "naïve", "日本", "#hash", "a|b", "100%"]
    line = lambda: " ".join(g.choices(words, k=g.randint(3, 14)))
    shared = [" ".join(g.choices(words, k=12)) + " and a tail of some length" for _ in range(6)]
    out = [(0, None), (1, ""), (2, "   \t\n \x0b"), (3, "\n\n\n"), (4, "one"), (5, "one two"), (5, "one two"), (None, shared[0]), (None, None)]
    for i in range(10, 10 + n):
        ls = [g.choice([line(), line(), g.choice(shared), g.choice(shared).upper() + "  ", ""]) for _ in range(g.randint(1, 8))]
        out.append((i, "\n".join(ls)))
    base = [line() for _ in range(30)]
    out.append((200, "\n".join(base)))
    out.append((201, "\n".join(base)))
    for i in range(202, 212):
        text = " ".join(base).split(" ")
        for _ in range(g.randint(0, 6)):
            text[g.randrange(len(text))] = g.choice(words)
        out.append((i, " ".join(text)))
    out.append((300, " ".join(g.choices(words, k=60_000))))
    out.append((301, "x" * 300_000))
    return out
