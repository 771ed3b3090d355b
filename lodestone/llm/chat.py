"""Chat formatting with Spark expressions only.

A conversation becomes one string. Its template, with ``<|`` opening every control string:

    <|im_start|>ROLE<newline>TEXT[<|im_sep|>TEXT...]<|im_end|><newline>

Neighbouring turns of one role share a block, with ``<|im_sep|>`` between their texts, so that single turns can be
read back. Inside roles and texts ``<|`` becomes ``<||`` (and a newline in a role ``<|nl|>``): control strings can't
occur there and escaping is undone exactly by the reverse replacements. The loss mask is a list of runs
(length, loss) over the whole string, in order: the assistant's texts, without the marks around them.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text, nulls first, so ties
and repeated rows have a fixed order and are all kept; a null conversation id is a conversation of its own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
#: Runs of a mask that are looked up together.
PAGE = 256


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NL))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NL), F.lit("\n")))


def format_conversations(rows: DataFrame, *, conv="conv_id", turn="turn", role="role", text="text", loss_role="assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask``, an array of (length, loss) runs that covers it."""
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))).alias("turns")
    )
    # turns of one role next to each other are merged: the first opens the block, the last closes it, and a turn between
    # has a mark in front. Only neighbours are looked at, so a conversation takes time in proportion to its length.
    role_at = lambda i: F.get("turns", i)["role"]
    mark = lambda c: F.struct(c.alias("s"), F.lit(False).alias("loss"))

    def runs_of(t: Column, i: Column) -> Column:
        opens = (i == 0) | (role_at(F.greatest(i - 1, F.lit(0))) != t["role"])
        closes = F.coalesce(role_at(i + 1) != t["role"], F.lit(True))
        own = F.array(
            mark(F.when(opens, F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP))),
            F.struct(escape(t["text"]).alias("s"), (t["role"] == loss_role).alias("loss")),
        )
        return F.concat(own, F.when(closes, F.array(mark(F.lit(END + "\n")))).otherwise(F.array().cast("array<struct<s:string,loss:boolean>>")))

    return turns.select("conv_id", F.flatten(F.transform("turns", runs_of)).alias("runs")).select(
        "conv_id",
        F.array_join(F.col("runs.s"), "").alias("formatted"),
        F.transform("runs", lambda r: F.struct(F.length(r["s"]).cast("long").alias("length"), r["loss"].alias("loss"))).alias("loss_mask"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted string alone: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def read(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring_index(F.substr(block, F.length(role) + 2), END, 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """The unescaped texts of a formatted string that lie under the loss mask, in order.

    The mask is taken in pages of ``PAGE`` runs. Each page finds its part of the string once, and its spans within that
    part, so that neither spans nor offsets are looked for from the start of a long conversation."""
    n = F.size(loss_mask)
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / PAGE).cast("int")), lambda k: F.slice(loss_mask, k.cast("int") * PAGE + 1, F.lit(PAGE)))
    none = F.array().cast("array<string>")
    lengths = F.transform(pages, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, r: a + r["length"]))
    first = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(lengths, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
    parts = F.transform(F.arrays_zip(pages.alias("runs"), lengths.alias("length"), starts.alias("at")), lambda p: F.struct(p["runs"].alias("runs"), F.substr(formatted, p["at"].cast("int"), p["length"].cast("int")).alias("text")))

    def spans(p: Column) -> Column:
        def add(a: Column, r: Column) -> Column:
            span = F.array(F.substr(p["text"], a["at"].cast("int"), r["length"].cast("int")))
            return F.struct((a["at"] + r["length"]).alias("at"), F.when(r["loss"], F.concat(a["found"], span)).otherwise(a["found"]).alias("found"))

        return F.aggregate(p["runs"], F.struct(F.lit(1).cast("long").alias("at"), none.alias("found")), add)["found"]

    return F.transform(F.flatten(F.transform(parts, spans)), unescape)
