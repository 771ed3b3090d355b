"""N-gram Jaccard join: exact near-duplicate classes by universe partition and pigeonhole.

Documents with equal shingle sets form a class; links are sought between classes. Every size band has a scheme that
splits the universe of shingles into more segments than linked sets can differ in, so linked sets agree on some
segments whole. The join indexes hashes of the segment subsets, each naming its scheme; a set also takes part in the
next larger scheme if a linked set can be there.

1. Signatures are grouped by value in packed blocks. A block holds each signature of an input slice at most once (the
   others are known to be shared and travel in any block), so a frequent signature is pre-aggregated.
2. Every class is compared with the class that leads most of its signatures; linked classes become components.
3. A signature whose classes lie in one component is settled. In the others, the classes outside the signature's main
   component are compared with all its classes. This is linear in the signature's size while they are few; where there
   are more than ``MINOR``, first the components' leaders are compared, which may merge them, and where there still
   are, the signature is left out.
4. Leaving out is free up to the scheme's spare segments (empty segments count too): linked sets agree on at least one
   segment more. Sets that exceed this are compared among themselves by cost-based allocation: their segment subsets
   and one-deletion neighbourhoods are indexed, each set skips its costly segments, probes some with the subset and the
   cheapest with all neighbours, so that allowances add up to more than a linked set can differ in.

Candidates pass size and parity-sketch bounds, neither of which loses a link, and are then verified on whole sets. At
no point are pairs of equal texts, all pairs of a group, or a group's documents in one task produced.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of
fewer words than a shingle is one shingle; rows with a null id have no links and a null component; repeated ids share
a component if their texts link (the component is the smallest id); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, ship
from . import common
from . import jaccard_sets as js
from . import textkernel as tk

#: A signature is compared out while at most so many of its classes lie outside its main component.
MINOR = 16
#: Entries (16 bytes) that a grouping task holds.
TASK_ENTRIES = 4 << 20
#: Words of 64 parity cells that accompany a set through an allocated join.
CELLS = 16
#: One segment in so many has one-deletion neighbours in an allocated join.
WIDE = 8
#: Tasks among which the pairs of one leading class are dealt.
SALTS = 256
#: A class of more rows than this meets them by broadcast: there is at most one such class for so many rows.
BIG_CLASS = 1 << 16
#: Seeds (for hash collisions) and spreads (for sets in too few segments) that are tried; each fails with a chance far below 1 %.
TRIES = 32
PLAIN, HEAD, SHARED, EMPTY = range(4)


def members(docs: DataFrame, spec: js.Spec, *, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n (size of the set), key and check (hashes of the set), sketch; sets may be empty (key is null)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w, at = js.shingle_sets(part.column(1), spec)
                key, check = js.class_keys(w, at)
                n = np.diff(at)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(key, mask=none), pa.array(check, mask=none), pa.array(js.sketches(w, at), pa.binary())], names=["id", "n", "key", "check", "sketch"]
                )

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n long, key long, check long, sketch binary")


def _blocks(rows: DataFrame, spec: js.Spec, n_parts: int) -> DataFrame:
    """Packed signatures of every input slice, by block."""

    def pack(part, kind, sig, key):
        order = np.argsort(part, kind="stable")
        part, sig, key = part[order], sig[order], key[order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(cut, [*cut[1:], len(part)]):
            yield int(part[a]), kind, sig[a:b].tobytes(), key[a:b].tobytes()

    def run(batches):
        for batch in batches:
            for piece in tk.slices(batch, "text", 4 << 20):
                w, at = js.shingle_sets(piece.column(0), spec)
                key, _ = js.class_keys(w, at)
                n = np.diff(at)
                first = np.unique(np.where(n > 0, key, 0), return_index=True)[1]
                first = first[n[first] > 0]
                pos, _ = js.pick_rows(at, first)
                own = key[first]
                sig, row, (er, es, en) = js.signatures(w[pos], np.concatenate(([0], np.cumsum(n[first]))), spec)
                order = np.argsort(sig, kind="stable")
                sig, k = sig[order], own[row[order]]
                again = np.concatenate(([False], sig[1:] == sig[:-1])) if len(sig) else np.zeros(0, bool)
                lead = np.concatenate((again[1:], [False])) & ~again if len(sig) else again
                part = ((sig >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int32)
                out = [
                    *pack(part[~again & ~lead], PLAIN, sig[~again & ~lead], k[~again & ~lead]),
                    *pack(part[lead], HEAD, sig[lead], k[lead]),
                    *pack((tk.mix(k[again].view(np.uint64)) % np.uint64(n_parts)).astype(np.int32), SHARED, sig[again], k[again]),
                    *pack((own[er] % n_parts).astype(np.int32), EMPTY, (en << js.SCHEME_BITS | es).astype(np.uint64), own[er]),
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int8(), pa.binary(), pa.binary()))], names=["part", "kind", "sig", "key"])

    return map_arrow(rows.select(F.col("text").cast("string").alias("text")), run, "part int, kind byte, sig binary, key binary")


def _shared(batches):
    """Entries (sig, key) of signatures that more than one class has, and the counts of empty segments."""
    got = [([], []) for _ in range(4)]
    for batch in batches:
        for kind, sig, key in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            got[kind][0].append(sig)
            got[kind][1].append(key)
    arrays = [(np.frombuffer(b"".join(s), np.uint64), np.frombuffer(b"".join(k), np.int64)) for s, k in got]
    del got

    def rows(kind, sig, key):
        for i in range(0, len(sig), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig[i : i + (1 << 16)]), kind, np.int8)), pa.array(sig[i : i + (1 << 16)].view(np.int64)), pa.array(key[i : i + (1 << 16)])], names=["kind", "sig", "key"])

    yield from rows(EMPTY, *arrays[EMPTY])
    yield from rows(PLAIN, *arrays[SHARED])
    sig = np.concatenate((arrays[PLAIN][0], arrays[HEAD][0]))
    key = np.concatenate((arrays[PLAIN][1], arrays[HEAD][1]))
    known = np.concatenate((np.zeros(len(arrays[PLAIN][0]), bool), np.ones(len(arrays[HEAD][0]), bool)))
    arrays.clear()
    order = np.argsort(sig, kind="stable")
    sig, key, known = sig[order], key[order], known[order]
    if len(sig):
        first = np.concatenate(([True], sig[1:] != sig[:-1]))
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        several = (np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at)) | np.logical_or.reduceat(known, at)
        keep = several[group]
        yield from rows(PLAIN, sig[keep], key[keep])


def _near(pairs: DataFrame, classes: DataFrame, spec: js.Spec) -> DataFrame:
    """Pairs (a, b) that sizes and parity sketches allow to link."""
    info = classes.select("key", "n", "sketch")
    both = pairs.join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")
    both = both.where((F.col("na") * spec.den >= F.col("nb") * spec.num) & (F.col("nb") * spec.den >= F.col("na") * spec.num))

    def run(batches):
        for batch in batches:
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(4))
            ok = [js.sketch_distance(x, y) <= spec.distance(int(t)) for x, y, t in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), total)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both.select("a", "b", "na", "sa", "nb", "sb"), run, "a long, b long")


def _sets(rows: DataFrame, classes: DataFrame, keys: DataFrame, spec: js.Spec, scratch: common.Scratch) -> DataFrame:
    """key and set (ascending hashes, 8 bytes each) of the classes with the given keys."""
    wanted = scratch.keep(classes.join(keys.select("key").distinct(), "key", "left_semi").select("key", F.col("rep").alias("id")))
    picked = rows.join(F.broadcast(wanted) if wanted.count() * 64 <= common.BROADCAST_LIMIT else wanted, "id").select("key", "text")

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w, at = js.shingle_sets(part.column(1), spec)
                key, _ = js.class_keys(w, at)
                same = np.flatnonzero(key == np.asarray(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(same)), pa.array([w[at[i] : at[i + 1]].tobytes() for i in same], pa.binary())], names=["key", "set"])

    # an id that several rows share may bring a set twice
    out = scratch.keep(map_arrow(picked, run, "key long, set binary").dropDuplicates(["key"]))
    scratch.drop(wanted)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, spec: js.Spec) -> DataFrame:
    """The pairs that link, by their whole sets. A class that leads many pairs has its set copied to ``SALTS`` tasks at
    most, and the pairs are dealt among them."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    led = pairs.join(sets.toDF("b", "sb"), "b").select("a", "b", "sb", salt)
    leads = pairs.select("a", salt).distinct().join(sets.toDF("a", "sa"), "a")
    both = led.join(leads, ["a", "salt"]).select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                inter = int(np.count_nonzero(z[1:] == z[:-1]))
                ok.append(spec.den * inter >= spec.num * (len(z) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def components(links: DataFrame, scratch: common.Scratch, base: DataFrame | None = None) -> DataFrame:
    """key and comp (smallest key that links reach) of every key in ``links`` (a, b) and of every key in ``base``, the
    components that earlier links gave.

    Links become edges between the components of ``base``. In each round every node hooks to its smallest neighbour if
    that is smaller, chains of hooks are halved until they are flat, and edges are contracted to the ends of the chains.
    The largest node of an edge always hooks, so the rounds end when no edge is left."""
    edges = links.select("a", "b")
    if base is not None:
        for end in ("a", "b"):
            named = base.select(F.col("key").alias(end), F.col("comp").alias("_comp"))
            edges = edges.join(named, end, "left").withColumn(end, F.coalesce("_comp", end)).drop("_comp")
    tidy = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges, found = scratch.keep(tidy(edges)), None
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.keep(ends.groupBy(F.col("a").alias("key")).agg(F.least(F.min("a"), F.min("b")).alias("comp")).withColumn("moved", F.lit(False)))
        while True:
            up = hooks.select(F.col("key").alias("comp"), F.col("comp").alias("_up"))
            flat = scratch.keep(hooks.select("key", "comp").join(up, "comp").select("key", F.col("_up").alias("comp"), (F.col("_up") != F.col("comp")).alias("moved")))
            scratch.drop(hooks)
            hooks = flat
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.select("key", "comp")
        before, contracted = edges, edges
        for end in ("a", "b"):
            contracted = contracted.join(hooks.select(F.col("key").alias(end), F.col("comp").alias("_comp")), end).withColumn(end, F.col("_comp")).drop("_comp")
        edges = scratch.keep(tidy(contracted))
        if found is not None:
            found, last = scratch.keep(_composed(found, hooks)), found
            scratch.drop(last, flat)
        else:
            found = flat.select("key", "comp")
            found._scratch = flat._scratch
        scratch.drop(before)
    scratch.drop(edges)
    if found is None:
        return base if base is not None else links.sparkSession.createDataFrame([], "key long, comp long")
    if base is None:
        return found
    out = scratch.keep(_composed(base, found))
    scratch.drop(found)
    return out


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(key, comp) of ``first`` with its components renamed as ``then`` says, and the keys that only ``then`` has."""
    renamed = first.join(then.select(F.col("key").alias("comp"), F.col("comp").alias("_comp")), "comp", "left").select("key", F.coalesce("_comp", "comp").alias("comp"))
    return renamed.unionByName(then.join(first.select("key"), "key", "left_anti").select("key", "comp"))


def _allocated(exceeding: DataFrame, sets: DataFrame, spec: js.Spec, scratch: common.Scratch) -> DataFrame:
    """Candidate pairs of different components among (key, scheme, comp) rows by subsets and one-deletion
    neighbourhoods with allocated costs. A pair is found from its larger set: as it can differ from a smaller one in
    no more shingles than two of its size, its allowance need only exceed that.

    A scheme's shingles are spread over so many segments that rare ones seldom share one. Non-empty subsets are indexed;
    one segment in ``WIDE`` also has its one-deletion neighbours (those that aren't empty). A set's allowance is the
    cheapest choice of subsets and neighbourhoods; there are several times as many as it needs.
    """
    rows = exceeding.join(sets, "key").select("key", "scheme", "comp", "set")
    cells = [f"p{i}" for i in range(CELLS)]

    def outline(batches):
        for batch in batches:
            w = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(3)]
            parity = np.array([np.packbits((np.bincount((x >> np.uint64(7)).astype(np.int64) & (64 * CELLS - 1), minlength=64 * CELLS) & 1).astype(np.uint8)).view(np.int64) for x in w]).reshape(-1, CELLS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in w], pa.int64()), *(pa.array(parity[:, i]) for i in range(CELLS)), batch.column(3)], names=["key", "scheme", "comp", "n", *cells, "set"])

    # a row for each set: what bounds a pair's difference (the index has the same columns)
    rows = scratch.keep(map_arrow(rows, outline, "key long, scheme int, comp long, n long, " + ", ".join(f"{c} long" for c in cells) + ", set binary"))
    outlines = rows.drop("set")
    small = F.broadcast if outlines.count() * 8 * (CELLS + 4) <= common.BROADCAST_LIMIT else lambda df: df

    def neighbours(batches, spread):
        for batch in batches:
            for i in range(batch.num_rows):
                scheme = int(batch.column(1)[i].as_py())
                w = np.frombuffer(batch.column(batch.num_columns - 1)[i].as_buffer(), np.uint64)
                far = int(spec.furthest[scheme])
                m = 3 * far + 2 if far >= 16 else 256
                seg = js.segment_of(w, np.full(len(w), m), spread)
                v, held = tk.mix(w + np.uint64(0x3C6EF372)), np.bincount(seg, minlength=m)
                with np.errstate(over="ignore"):
                    total = np.zeros(m, np.uint64)
                    np.add.at(total, seg, v)
                    salt = lambda s, j: tk.mix(s + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme << 50)).view(np.int64)
                    full = np.flatnonzero(held)
                    cut = np.flatnonzero((seg % WIDE == 0) & (held[seg] > 1))
                    h = np.concatenate((salt(total[full], full), salt(total[seg[cut]] - v[cut], seg[cut])))
                n, at = len(h), np.concatenate((full, seg[cut]))
                wide = (at % WIDE == 0) & (held[at] > 1)  # of one shingle, the only neighbour would be empty
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in range(2, batch.num_columns - 1)), pa.array(np.full(n, batch.column(0)[i].as_py(), np.int64)), pa.array(np.full(n, scheme, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.repeat([0, 1], [len(full), len(cut)]).astype(np.int32)), pa.array(wide), pa.array(h)],
                    names=["comp", "n", *cells, "key", "scheme", "seg", "cut", "wide", "h"],
                )

    schema = "comp long, n long, " + ", ".join(f"{c} long" for c in cells) + ", key long, scheme int, seg int, cut int, wide boolean, h long"
    for spread in range(TRIES):  # another spread in the event that a set's shingles share too few segments for its allowance
        index = scratch.keep(map_arrow(rows, partial(neighbours, spread=spread), schema))
        gain = F.count_if(F.col("cut") == 0) + F.count_distinct(F.when(F.col("cut") == 1, F.col("seg")))
        need = F.floor(2 * F.col("n") * (spec.den - spec.num) / (spec.den + spec.num)) + 1
        if index.groupBy("key", "scheme", "n").agg(gain.alias("gain")).where(F.col("gain") < need).isEmpty():
            break
        scratch.drop(index)
    else:
        raise RuntimeError("no spread gives every set the segments that its allowance needs")
    # what a probe meets: level 0 the equal subsets; level 1 also sets with one shingle more or one fewer
    subset, wide = index.where("cut = 0"), index.where("wide")
    probes = subset.select("key", "scheme", "n", "seg", F.lit(0).alias("level"), "h", F.lit(0).alias("meets"))
    probes = probes.unionByName(wide.select("key", "scheme", "n", "seg", F.lit(1).alias("level"), "h", (1 - F.col("cut")).alias("meets")))
    counts = index.groupBy("h", F.col("cut").alias("meets")).agg(F.count("*").alias("c"))
    costs = probes.join(counts, ["h", "meets"], "left").groupBy("key", "scheme", "n", "seg", "level").agg(F.sum(F.coalesce("c", F.lit(0))).alias("cost"))

    def allocate(key, table):
        import heapq

        n = table.column("n")[0].as_py()
        need = spec.distance(2 * n) + 1
        price = {(s, lv): c for s, lv, c in zip(*(table.column(c).to_pylist() for c in ("seg", "level", "cost")))}
        heap = [(c, s, 0) for (s, lv), c in price.items() if lv == 0]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < need:
            _, s, lv = heapq.heappop(heap)
            out.append((s, lv))
            if lv == 0 and (s, 1) in price:
                heapq.heappush(heap, (price[s, 1], s, 1))
        return pa.table({"key": pa.array([key[0].as_py()] * len(out), pa.int64()), "scheme": pa.array([key[1].as_py()] * len(out), pa.int32()), "seg": pa.array([s for s, _ in out], pa.int32()), "level": pa.array([x for _, x in out], pa.int32())})

    ship(exceeding.sparkSession)
    chosen = costs.groupBy("key", "scheme").applyInArrow(allocate, "key long, scheme int, seg int, level int")
    live = probes.join(chosen, ["key", "scheme", "seg", "level"], "left_semi").select("key", "scheme", "h", "meets")
    # the sketches' bound is part of the join
    x = live.join(small(outlines), ["key", "scheme"]).alias("x")
    y = index.select("key", "h", F.col("cut").alias("meets"), "comp", "n", *cells).alias("y")
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in cells[1:]), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    near = differ * (spec.den + spec.num) <= (F.col("x.n") + F.col("y.n")) * (spec.den - spec.num)
    larger = (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key"))
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.meets") == F.col("y.meets")) & larger & (F.col("x.comp") != F.col("y.comp")) & near)
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def link_classes(rows: DataFrame, spec: js.Spec, n_entries: int, classes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Components of linked classes: (key, comp) for those that link with another; rows: id, text."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(width, n_entries // TASK_ENTRIES + 1)
    found = scratch.keep(map_arrow(_blocks(rows, spec, 4 * n_tasks).repartition(n_tasks, "part"), _shared, "kind byte, sig long, key long"))
    # a class that copies brought into several slices may stand twice in a signature; all counts that decide are distinct
    entries = found.where(F.col("kind") == PLAIN).select("sig", "key")
    ends = lambda near: near.select(F.explode(F.array("a", "b")).alias("key"))

    # every class against the class that leads most of its signatures
    lead = scratch.keep(entries.groupBy("sig").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("sig", "a"))
    votes = entries.join(lead, "sig").where("a <> key").groupBy("key", "a").agg(F.count("*").alias("n"))
    pairs = votes.groupBy(F.col("key").alias("b")).agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    near = scratch.keep(_near(pairs, classes, spec))
    scratch.drop(lead)
    sets = _sets(rows, classes, ends(near), spec, scratch)
    links = [scratch.keep(_verified(near, sets, spec))]
    scratch.drop(near, sets)
    comps = components(links[0], scratch)

    # signatures that still join several components: compared out where they are small; in the others the components'
    # leaders (the first, then the last of each component) are compared, which merges what belongs together
    left, near = entries, None
    for turn in range(3):
        leader = (F.min, F.max, F.min)[turn]
        placed = left.join(comps, "key", "left").select("sig", "key", F.coalesce("comp", "key").alias("comp"))
        sizes = placed.distinct().groupBy("sig", "comp").agg(F.count("*").alias("c"), leader("key").alias("leader"))
        main = sizes.groupBy("sig").agg(F.max_by(F.struct("comp", "leader"), F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("minor")).where("minor > 0")
        main = scratch.keep(main.select("sig", "main.comp", "main.leader", "minor").toDF("sig", "main", "main_leader", "minor"))
        open_ = scratch.keep(placed.join(main, "sig").distinct())
        scratch.drop(main, left if turn else None)
        small = open_.where(F.col("minor") <= MINOR)
        few = small.where("comp <> main").select("sig", F.col("key").alias("x"), F.col("comp").alias("cx"))
        # the rows of this join are at most MINOR times the entries
        rest = few.join(small.select("sig", F.col("key").alias("y"), F.col("comp").alias("cy")), "sig").where("cx <> cy")
        pairs = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        large = open_.where(F.col("minor") > MINOR)
        if turn < 2:
            leaders = large.where("comp <> main").groupBy("sig", "comp").agg(leader("key").alias("x"), F.first("main_leader").alias("y"))
            pairs = pairs.unionByName(leaders.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        near = scratch.keep(_near(pairs.distinct(), classes, spec))
        if not near.isEmpty():
            sets = _sets(rows, classes, ends(near), spec, scratch)
            links.append(scratch.keep(_verified(near, sets, spec)))
            comps, last = components(links[-1], scratch, comps), comps
            scratch.drop(sets, None if comps is last else last)
        left = scratch.keep(large.select("sig", "key"))
        scratch.drop(near, open_)
        if left.isEmpty():
            break

    # sets with more left-out or empty segments than their scheme can spare
    scheme = F.col("sig").bitwiseAND((1 << js.SCHEME_BITS) - 1).cast("int")
    out = left.select("key", scheme.alias("scheme"), F.lit(1).cast("long").alias("n"))
    # a class that copies brought into several slices has the same count in each
    gaps = found.where(F.col("kind") == EMPTY).select("key", scheme.alias("scheme"), F.shiftright("sig", js.SCHEME_BITS).alias("n")).distinct()
    at_scheme = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("scheme") + 1)
    schemes = np.arange(len(spec.bounds) - 1)
    # linked sets agree on all segments but as many as they can differ in, given this one's size
    partner = F.least(at_scheme(spec.bounds[1:] - 1), F.floor(F.col("size") * spec.den / spec.num))
    spare = at_scheme(spec.segments(schemes)) - 1 - F.floor((F.col("size") + partner) * (spec.den - spec.num) / (spec.den + spec.num))
    counts = out.unionByName(gaps).groupBy("key", "scheme").agg(F.sum("n").alias("n")).where(F.col("n") >= at_scheme(spec.spare(schemes)))
    exceeding = scratch.keep(counts.join(classes.select("key", F.col("n").alias("size")), "key").where(F.col("n") > spare).select("key", "scheme"))
    scratch.drop(found, left)
    if not exceeding.isEmpty():
        sets = _sets(rows, classes, exceeding, spec, scratch)
        placed = exceeding.join(comps, "key", "left").select("key", "scheme", F.coalesce("comp", "key").alias("comp"))
        near = scratch.keep(_near(_allocated(placed, sets, spec, scratch), classes, spec))
        comps = components(_verified(near, sets, spec), scratch, comps)
    return comps


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """For every document: id, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    with common.Scratch(docs.sparkSession, "jaccard") as scratch:
        for seed in range(TRIES):  # another seed in the event that two sets have one 64-bit key, which the check hash shows
            spec = js.Spec(words, num, den, seed)
            own = scratch.keep(members(docs, spec, id_col=id_col, text_col=text_col))
            usable = own.where("key is not null and id is not null")
            classes = scratch.keep(usable.groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count_if(F.lit(True)).alias("rows"), F.min("check").alias("c1"), F.max("check").alias("c2")))
            stats = classes.agg(F.count_if(F.expr("c1 <> c2")).alias("bad"), F.sum("n").alias("n")).first()
            if not stats["bad"]:
                break
            scratch.drop(own, classes)
        else:
            raise RuntimeError("every seed gave two sets one key")
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        comps = link_classes(rows, spec, int((stats["n"] or 0) * 0.36), classes, scratch)
        grouped = classes.select("key", "rep", "rows").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        smallest = grouped.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = scratch.keep(grouped.join(smallest, "comp").select("key", "component_id", "rows"))
        # rows without a set, rows of the few large classes, and the rest
        own, big = own.select("id", "n", "key"), F.broadcast(named.where(F.col("rows") > BIG_CLASS).drop("rows"))
        sets = own.where("key is not null")
        rest = sets.join(big.select("key"), "key", "left_anti").join(named.where(F.col("rows") <= BIG_CLASS).drop("rows"), "key", "left")
        parts = own.where("key is null").withColumn("component_id", F.col("id")).unionByName(sets.join(big, "key")).unionByName(rest)
        # a row with a null id belongs to a class only if others have its set
        with common.shuffles_dropped(docs.sparkSession):
            return common.checkpointed(parts.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")))
