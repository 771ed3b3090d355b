"""The ten operators against brute force, over awkward rows, empty tables and columns with clashing names."""

import collections
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, html_extract, jaccard_join, jaccard_sets, language_id, line_dedup, packing, quality_classifier, quality_rules, queries, toxicity
from lodestone.llm import textkernel as tk
from tests.llm import fixtures as fx
from tests.oracle import same

WHITE, LOWER = re.compile(r"[^\x20\x09-\x0D]+"), {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


# --- kernel


def test_tokens_and_hashes():
    texts = [t for _, t in fx.awkward()]
    buf, offs = tk.load(pa.array(texts, pa.string()))
    s, e, r = tk.spans(buf, offs, tk.IS_WHITE)
    raw = buf.tobytes()
    want = [(i, w) for i, t in enumerate(texts) for w in WHITE.findall(t or "")]
    assert [(int(i), raw[a:b].decode()) for a, b, i in zip(s, e, r)] == want
    by = {}
    for h, (_, w) in zip(tk.hash_spans(buf, s, e).tolist(), want):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    ls, le, lr = tk.lines(buf, offs)
    assert [(int(i), raw[a:b].decode()) for a, b, i in zip(ls, le, lr)] == [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n")]


# --- 1 line dedup


def brute_lines(texts, min_docs=5):
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(norm(x)) >= 40 and i is not None:
                held[norm(x)].add(i)
    out = []
    for i, t in texts:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (i is not None and len(norm(x)) >= 40 and len(held[norm(x)]) >= min_docs and max(held[norm(x)]) != i)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def applied(df, index):
    return sorted((tuple(r) for r in line_dedup.apply(df, index).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def test_line_dedup(spark):
    texts = fx.awkward()
    df = fx.frame(spark, texts)
    index = line_dedup.LineIndex.build(df)
    assert applied(df, index) == brute_lines(texts) and sum(x[2] for x in brute_lines(texts)) > 50
    empty = fx.empty(spark)
    assert applied(empty, line_dedup.LineIndex.build(empty)) == []


def test_line_dedup_is_reversible(spark):
    texts = fx.awkward()
    half, rest = texts[::2], texts[1::2]
    index = line_dedup.LineIndex.build(fx.frame(spark, half), shard_keys=2)
    both = index.insert(fx.frame(spark, rest))
    everything = fx.frame(spark, texts)
    assert applied(everything, both) == brute_lines(texts)
    back = both.delete(fx.frame(spark, [x for x in rest if x[0] not in {i for i, _ in half}]))
    refs = lambda i: sorted(map(tuple, i.refs.select("hi", "lo", "n_docs", "keeper").collect()))
    assert refs(back) == refs(line_dedup.LineIndex.build(fx.frame(spark, [x for x in texts if x[0] in {i for i, _ in half}])))
    h = line_dedup._filter_hash([r["hi"] for r in back.shared().collect()])
    filters = {r["shard"]: line_dedup.Cuckoo.load(bytes(r["filter"])) for r in back.filters.collect()}
    shards = [r["s"] for r in back.shared().select(line_dedup._shard(back.n_shards).alias("s")).collect()]
    assert all(filters[s].contains(np.array([x]))[0] for s, x in zip(shards, h))


def test_line_dedup_without_filters_gives_the_same(spark, monkeypatch):
    texts = fx.awkward()
    df = fx.frame(spark, texts)
    index = line_dedup.LineIndex.build(df)
    monkeypatch.setattr(line_dedup.common, "BROADCAST_LIMIT", -1)
    assert applied(df, index) == brute_lines(texts)


def test_cuckoo_filter():
    g = np.random.default_rng(1)
    h = g.integers(0, 2**63, 5000).astype(np.uint64)
    f = line_dedup.Cuckoo.sized(len(h))
    f.insert(h)
    assert f.contains(h).all() and f.contains(g.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    f = line_dedup.Cuckoo.load(f.dump())
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.05
    tiny = line_dedup.Cuckoo.sized(2)
    tiny.insert(h[:100])  # far too many: the rest is remembered whole
    assert tiny.contains(h[:100]).all()


# --- 2 and 3 quality


def base_brute(t):
    w = WHITE.findall(t or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WHITE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def noisy(seed=2, n=240):
    g = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        body = g.choices(words, k=120)
        good = i % 3 != 0
        texts.append((i, " ".join(w if good else w + g.choice(["%%%", "***", "$$$"]) for w in body)))
        labels.append((i, int(good), int(i % 4 == 0)))
    return texts, labels


def test_quality_rules_base_counts(spark):
    texts = fx.awkward()
    df = fx.frame(spark, texts)
    model = quality_rules.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_rules.assess(df, model).collect()
    want = collections.Counter((i, *base_brute(t)) for i, t in texts)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(0 <= r["score"] <= 1 and r["kept"] == (not r["base_failed"] and r["score"] >= 0.5) for r in got)
    assert quality_rules.assess(fx.empty(spark), model).count() == 0


def test_quality_rules_learn(spark):
    texts, labels = noisy()
    df, lab = fx.frame(spark, texts), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.assess(df, quality_rules.train(df, lab, max_train=150)).collect()}
    assert np.mean([got[i] == bool(q) for i, q, _ in labels]) > 0.95


def test_quality_classifier(spark):
    texts, labels = noisy()
    df, lab = fx.frame(spark, [*texts, (900, None), (901, ""), (None, "x"), (902, "y" * 100_000)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.train(df, lab)
    site = F.concat_ws("/", "source", "lang")
    got = quality_classifier.judged(df, model, site).collect()
    assert len(got) == 244
    kept = {r["doc_id"]: r["_ls_kept"] for r in got}
    assert np.mean([kept[i] == bool(q) for i, q, _ in labels]) > 0.95
    # the posterior of every row by hand
    p = lambda z: 1 / (1 + np.exp(-z))
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        hosts[r["_ls_host"]].append(p(r["_ls_ratio"]))
        paths[r["_ls_path"]].append(p(r["_ls_ratio"]))
    n = len(got)
    rate = (sum(map(sum, hosts.values())) + 1) / (n + 2)
    # method of moments for Beta-binomial groups: variance within the parent over variance between groups, less one
    def strength(groups, parent_of, variance):
        parents = collections.defaultdict(list)
        for k, v in groups.items():
            parents[parent_of(k)].append(v)
        mean = {h: rate if h == "all" else sum(map(sum, vs)) / sum(map(len, vs)) for h, vs in parents.items()}
        spread = sum(len(v) * (np.mean(v) - mean[parent_of(k)]) ** 2 for k, v in groups.items())
        chance = sum((len(vs) - 1) * mean[h] * (1 - mean[h]) for h, vs in parents.items())
        room = sum(sum(map(len, vs)) - sum(len(v) ** 2 for v in vs) / sum(map(len, vs)) for vs in parents.values())
        between = (spread - chance) / room if room else 0
        return float(np.clip(variance / between - 1, 2, 1e4)) if between > 0 else 1e4

    hs = strength(hosts, lambda k: "all", rate * (1 - rate))
    host_of = {r["_ls_path"]: r["_ls_host"] for r in got}
    hr = {h: np.mean(v) for h, v in hosts.items()}
    ps = strength(paths, host_of.get, sum(len(v) * np.mean(v) * (1 - np.mean(v)) for v in hosts.values()) / n)
    for r in got:
        own = p(r["_ls_ratio"])
        h = (sum(hosts[r["_ls_host"]]) - own + hs * rate) / (len(hosts[r["_ls_host"]]) - 1 + hs)
        q = (sum(paths[r["_ls_path"]]) - own + ps * h) / (len(paths[r["_ls_path"]]) - 1 + ps)
        want = p(r["_ls_ratio"] + np.clip(np.log(q / (1 - q)), -3, 3))
        assert abs(r["_ls_score"] - want) < 1e-6
    assert quality_classifier.kept(df, model, site).columns == df.columns
    assert quality_classifier.kept(fx.empty(spark), model, site).count() == 0


def test_site_strength_is_that_of_the_draw():
    """Groups drawn from Beta distributions of a known strength give that strength back."""
    g = np.random.default_rng(8)
    for rate, strength in ((0.5, 10), (0.1, 30), (0.8, 5)):
        n = g.integers(200, 400, 3000)
        k = g.binomial(n, g.beta(rate * strength, (1 - rate) * strength, len(n)))
        r = k.sum() / n.sum()
        got = quality_classifier._strength((n * (k / n - r) ** 2).sum(), (len(n) - 1) * r * (1 - r), n.sum() - (n**2).sum() / n.sum(), r * (1 - r))
        assert abs(got / strength - 1) < 0.15, (rate, strength, got)
    assert quality_classifier._strength(0.0, 1.0, 10.0, 0.25) == 1e4 and quality_classifier._strength(None, None, None, 0.25) == 1e4


def test_a_sites_rate_turns_a_verdict(spark):
    """The same text with weak evidence is kept on a good host and rejected on a bad one; on a site of one document it
    gets what the global rate says."""
    good, bad = [(i, f"plain words number {i} " * 20, "good.example/a") for i in range(60)], [(100 + i, "### " * 40 + f"x{i}", "bad.example/a") for i in range(60)]
    model = quality_classifier.Evidence(np.zeros(14), np.ones(14), np.array([0, 0, 0, -20.0] + [0] * 10), 4.0, 0.0)
    text = next(t for t in ("word " * k + "# " * 8 for k in range(30, 400)) if abs(model.ratio(quality_classifier.features(pa.array([t])))[0]) < 0.3)
    rows = [*good, *bad, (500, text, "good.example/a"), (501, text, "bad.example/a"), (502, text, "new.example/b")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, site string, rate int")
    got = {r["doc_id"]: r for r in quality_classifier.judged(df, model, F.col("site")).collect()}
    assert got[500]["_ls_kept"] and not got[501]["_ls_kept"]
    assert got[501]["_ls_score"] < got[502]["_ls_score"] < got[500]["_ls_score"]
    assert {r["rate"] for r in got.values()} == {1} and quality_classifier.kept(df, model, F.col("site")).columns == df.columns


# --- 4 toxicity


def ftrl_brute(rows, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=4):
    """FTRL-proximal one coordinate at a time, over dictionaries."""
    import math

    z, n, zb, nb = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    rng = np.random.default_rng(11)
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for j in rng.permutation(np.arange(len(rows))):
            y, x = rows[j]
            own = {i: w(i) for i in x}
            wb = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(sum(own.values()) + wb))) - y
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * own[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    return {i: w(i) for i in z if w(i)}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_ftrl_against_one_coordinate_at_a_time():
    g = random.Random(12)
    rows = [(int(i % 3 == 0), sorted(set(g.sample(range(50), 12)) | ({60, 61} if i % 3 == 0 else {70}))) for i in range(120)]
    at = np.concatenate(([0], np.cumsum([len(x) for _, x in rows])))
    idx, weight, offset = toxicity.ftrl(np.array([float(y) for y, _ in rows]), at, np.array([i for _, x in rows for i in x], np.int32))
    want, want_offset = ftrl_brute(rows)
    assert dict(zip(idx.tolist(), weight)).keys() == want.keys() and abs(offset - want_offset) < 1e-9
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(idx.tolist(), weight))



def test_toxicity(spark, sf):
    g = random.Random(4)
    words, bad = [f"word{i}" for i in range(200)], ["idiot", "moron", "scum"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = g.choices(words, k=g.randint(30, 200))
        for _ in range(3 * toxic):
            body.insert(g.randrange(len(body)), g.choice(bad))
        texts.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    df = fx.frame(spark, [*texts, (9000, None), (9001, ""), (None, "idiot")])
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    seen = toxicity.common.labelled_sample(lab, "doc_id", "toxic", 10_000, keep=lambda c: ~toxicity.held_out(c))
    assert all(zlib.crc32(str(r["_id"]).encode()) % 5 for r in seen.collect())
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert len(model.idx) < 1 << 16 and 0 <= got[9000]["score"] <= 1 and got[9001]["score"] == got[9000]["score"]
    assert toxicity.score(fx.empty(spark), model).count() == 0
    assert toxicity.train(df, lab.where("toxic = 1")).score(pa.array(["x"]))[0] > 0.5


# --- 5 chat


def test_chat_merges_and_reads_back(spark):
    rows = [
        (1, 0, "user", "a<|im_end|>b"), (1, 1, "user", "<||x<|"), (1, 2, "assistant", "c"), (1, 3, "assistant", None), (1, 4, "assistant", "<|im_sep|>"), (1, 5, None, "n"),
        (2, None, "assistant", "late"), (2, 0, "sys\ntem<|", "x"), (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "assistant", "\n\n"), (4, 0, "assistant", "z" * 200_000), (5, 0, "user", None),
    ]
    df = spark.createDataFrame([(*r, "extra", "x") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    made = chat.format_conversations(df).select("*", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for m in made:
        own = sorted([r for r in rows if r[0] == m["conv_id"]], key=order)
        assert [(t["role"], t["text"]) for t in m["t"]] == [(r[2] or "", r[3] or "") for r in own]
        assert list(m["l"]) == [r[3] or "" for r in own if r[2] == "assistant"]
        assert sum(x["length"] for x in m["loss_mask"]) == len(m["formatted"])
    one = next(m for m in made if m["conv_id"] == 1)
    assert one["formatted"].count("<|im_start|>") == 3 and one["formatted"].count("<|im_sep|>") == 3
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- 6 language


def test_long_conversations_take_time_in_proportion(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("so <| many turns "), F.col("id")).alias("text"))
        began = time.time()
        made = chat.format_conversations(rows)
        r = made.select(F.size(chat.turns_of(F.col("formatted"))).alias("n"), chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("chars"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("covered")).first()
        assert r["n"] == n and r["loss"] == [f"so <| many turns {i}" for i in range(1, n, 2)] and r["chars"] == r["covered"]
        return time.time() - began

    took(1_000)
    assert took(20_000) < 4 * took(10_000) + 2


def test_letters_are_of_category_l():
    model = language_id.LanguageModel({"a": b"some words of one language " * 50, "b": "einige Wörter einer Sprache ".encode() * 50})
    assert [model.classify(t)[0] for t in ("½ ²", "①", "12_3", "", None)] == ["und"] * 5 and model.classify("words of one")[0] == "a"


def test_language_against_plain_compression(spark, sf):
    """With dictionaries of one size the choice is the smallest sum of pieces, compressed one by one."""
    import zstandard

    trained = language_id.train(spark.read.parquet(f"{sf}/documents.parquet")).dictionaries
    model = language_id.LanguageModel({k: v[-min(map(len, trained.values())) :] for k, v in trained.items()})
    names = list(model.dictionaries)
    assert len(names) > 2 and len(set(model.steps)) == 1
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").orderBy("doc_id").limit(60).collect():
        raw = f" {re.sub(r'[\W\d_]+', ' ', r['text'].lower()).strip()} ".encode()
        sums = []
        for name in names:
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sums.append(sum(len(c.compress(raw[i : i + language_id.PIECE])) for i in range(0, len(raw), language_id.PIECE)))
        if language_id.has_letter(r["text"]):
            assert model.classify(r["text"])[0] == names[int(np.argmin(sums))]


def test_language_id(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(df)
    assert set(model.dictionaries) <= {"en", "de", "fr", "es"}
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    held = [r for r in df.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and len(r["text"]) > 100]
    assert np.mean([got[r["doc_id"]]["best"] == r["lang"] for r in held]) > 0.9
    odd = {r["doc_id"]: r for r in language_id.identify(fx.frame(spark, [(1, None), (2, ""), (3, "123 !? ٣"), (4, "a"), (5, "the and " * 30_000)]), model).collect()}
    assert [odd[i]["best"] for i in (1, 2, 3)] == ["und"] * 3 and odd[4]["best"] != "und" and 0 <= odd[5]["score"] <= 1
    assert language_id.identify(fx.empty(spark), model).count() == 0
    nothing = language_id.train(fx.empty(spark))
    assert nothing.classify("some text") == ("und", 0.0, 0.0)


def test_rare_languages_leave_others_alone(spark):
    """A language of one short document shrinks no other one's dictionary, and its own texts are still found."""
    g = random.Random(4)
    words = {lang: ["".join(g.choices(part, k=g.randint(2, 9))) for _ in range(3000)] for lang, part in (("en", "etaoinshrdlu"), ("de", "äenisratdhkz"), ("el", "αβγδεηικλμνο"))}
    often = [1 / (i + 1) for i in range(3000)]  # as in natural languages, some words are frequent
    text = lambda lang, n: " ".join(g.choices(words[lang], often, k=n))
    docs = [(i, text("en", 900), "en") for i in range(100)] + [(i, text("de", 30_000 if i == 200 else 40), "de") for i in range(150, 210)]
    fields = "doc_id long, text string, lang string"
    one = language_id.train(spark.createDataFrame(docs, fields))
    # a mistyped value and a rare language
    more = [(next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 != 2 and i % 2 == odd), text(of, 30), lang) for odd, of, lang in ((0, "en", "eng"), (1, "el", "el"))]
    two = language_id.train(spark.createDataFrame(docs + more, fields))
    assert {len(x) for x in one.dictionaries.values()} == {language_id.DICT_BYTES}  # also of few documents with one long text
    assert {k: two.dictionaries[k] for k in ("en", "de")} == one.dictionaries
    unseen = [text(lang, n) for lang in ("en", "de") for n in (20, 200, 4000)]
    assert [two.classify(t)[0] for t in unseen] == [one.classify(t)[0] for t in unseen] == ["en"] * 3 + ["de"] * 3
    assert two.classify(more[1][1])[0] == two.classify(text("el", 50))[0] == "el"


def test_dictionaries_learn_beyond_common_headers(spark):
    head = "all rights reserved under the licence that comes with this collection of texts " * 40
    words = {"en": "water house green".split(), "de": "wasser haus grün".split()}
    docs = [(i, head + " ".join(f"{w}{'abcdefghij'[(i + j) % 10]}" for j in range(400) for w in words[lang]), lang) for i in range(800) for lang in (("en", "de")[i % 2],)]
    model = language_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    for lang, (w, *_) in words.items():
        assert 2 * model.dictionaries[lang].count(b"licence") < model.dictionaries[lang].count(w.encode())
        assert model.classify(" ".join(f"{w}{x}" for w in words[lang] for x in "abcdefg"))[0] == lang


def test_small_dictionaries_are_compared_at_their_size():
    g = random.Random(5)
    words = ["".join(g.choices("abcdefgh", k=g.randint(3, 7))) for _ in range(2500)]
    sets = words[:1500], words[1000:]  # two languages that share words
    texts = [" ".join(g.choices(w, k=40_000)).encode() for w in sets]
    model = language_id.LanguageModel({"big": texts[0][: language_id.DICT_BYTES], "small": texts[1][:8000]}, {"big": 1000, "small": 5})
    found = [[model.classify(" ".join(g.choices(w, k=150)))[0] for _ in range(40)] for w in sets]
    assert found[0].count("big") >= 38 and found[1].count("small") >= 38


def test_narrow_margins_are_rejected(spark):
    model = language_id.LanguageModel({"a": b"the and of " * 50, "b": b"the and of " * 50}, {"a": 1, "b": 2})
    (r,) = language_id.identify(fx.frame(spark, [(1, "the and of")]), model).collect()
    assert r["lang"] is None and r["best"] == "b" and r["margin"] == 0


# --- 7 decontamination


def contamination(texts, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pat.findall((t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            if i is not None:
                wins[tuple(w[a : a + k])].add(str(i))
            else:
                wins[tuple(w[a : a + k])]
    out = []
    for i, t in texts:
        w, hit, its = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    hit.update(range(a, a + k))
                    its |= wins[x]
        out.append((i, len(w), len(hit), tuple(sorted(its))))
    return collections.Counter(out)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_decontamination(spark, limit):
    texts = fx.awkward()
    long = next(t for i, t in texts if i == 200).split()
    items = [(1, " ".join(long[3:40])), (2, "ONE"), (3, "w1 w2"), (4, None), (5, ""), (6, " ".join(long[20:30]).upper()), (6, " ".join(long[20:30])), (10, "a|b 100%"), (None, "one two"), (7, " ".join(long[50:61]) + " never")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, win string")
    df = fx.frame(spark, texts)
    got = decontaminate.match(df, bench, broadcast_windows=limit).select("doc_id", "n_words", decontaminate.n_hit(F.col("spans")).alias("h"), "items").collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["h"], tuple(r["items"])) for r in got) == contamination(texts, items)
    bad = {i for (i, _, h, _) in contamination(texts, items) if h}
    cleaned = decontaminate.clean(df, bench)
    assert cleaned.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in cleaned.collect()))) == sorted(repr(i) for i, _ in texts if i not in bad)


def test_decontamination_of_nothing(spark):
    df, bench = fx.frame(spark, fx.awkward()), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.match(df, bench).where("size(spans) > 0").count() == 0 and decontaminate.match(df, bench).count() == df.count()
    assert decontaminate.match(fx.empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- 8 html


def test_blocks_of_broken_pages():
    b = lambda h: [x[1] for x in html_extract.blocks(h)]
    assert b("<p>a<p>b &amp; c<br>d</p><script>x<p></script>e<!-- f --><ul><li>g<li>h &lt;") == ["a", "b & c d", "e", "g", "h <"]
    assert b("") == [] and b("   ") == [] and b("<p") == [] and b("x < y <p class='a>b'>z") == ["x < y", "z"] and b("<script>never ends <p>x") == []
    assert b("<div>one <b>two</b>\n three&nbsp;four</div>") == ["one two three four"]
    assert len(b("<p>x" * 20_000)) == 20_000


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        began = time.time()
        got = html_extract.blocks("".join(f"<div class=c{i % 7}>t{i}" for i in range(n)) + "</p>" * n + "</div>" * n)
        html_extract.encode([got])
        assert [b[1] for b in got] == [f"t{i}" for i in range(n)]
        return time.time() - began

    took(1_000)
    assert took(20_000) < 4 * took(10_000) + 1


def test_blocks_after_embedded_elements():
    b = lambda h: [x[1] for x in html_extract.blocks(h)]
    article = "<article><p>one</p>{}<p>two</p></article><p>three</p>"
    assert b(article.format("<embed src=x.swf>")) == b(article.format("<EMBED src=x.swf width=1/>")) == ["one", "two", "three"]
    for tag in ("svg", "object", "canvas", "audio", "video", "template"):
        assert b(article.format(f"<{tag} class=x>")) == ["one", "two", "three"]
        assert b(article.format(f"<{tag}><p>x</p><{tag}>y</{tag}>z</{tag}>")) == ["one", "two", "three"]
        assert b(article.format(f"<{tag}><p>x</p><!-- </{tag}> --><script>'</{tag}>'</script><{tag}>y</{tag}>")) == ["one", "x", "two", "three"]
        assert b(article.format(f"<{tag}-icon>w</{tag}-icon>")) == ["one", "w", "two", "three"]
    assert b("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<p><math>y") == ["so x=2 holds", "y"]
    assert b("<p>x<svg>" * 20_000) == ["x"] * 20_000


PAGES = [
    ("<nav><a href=/>Home</a></nav><article><h1>A title</h1><p>First paragraph of the story.</p><div class=ad>Buy this now.</div><p>Second &eacute; paragraph.</p></article><footer>&copy; us</footer>", "A title\n\nFirst paragraph of the story.\n\nSecond é paragraph."),
    ("<div class='menu'><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div id=content><h1>Heading here</h1><p>Some prose that is long enough to be read.</p></div><div class='comments'><p>Nice post, thanks.</p></div>", "Heading here\n\nSome prose that is long enough to be read."),
    ("<main><h1>Only this</h1><p>Body of the page.</p></main><aside class=sidebar><h3>Related</h3><ul><li>other</ul></aside><form><label>Mail</label><button>Send</button></form>", "Only this\n\nBody of the page."),
    (None, ""), ("", ""), ("<html><body></body>", ""),
]


def test_html_extraction(spark, sf):
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df, carry=("url",)).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == [t for _, t in PAGES]
    assert html_extract.extract(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    out = {r["page_id"]: r["text"] for r in queries.QUERIES["op8_html_extraction"](spark, sf).collect()}
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html_extract.html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert out[r["page_id"]] == "\n\n".join(x for x in want if x)


def test_labeller_on_unseen_generated_pages():
    model, right, n = html_extract.trained(), 0, 0
    for page, y in html_extract.generated(60, seed=1234):
        z = np.array(model.main([page])[0])
        right, n = right + (z == (y > 0)).sum(), n + len(y)
    assert right / n > 0.99


def test_labeller_gradients():
    (page, y), model = html_extract.generated(1, seed=8)[0], html_extract.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    coded, sizes = html_extract.encode([page]), np.array([len(page)])
    _, grad = model.gradients(coded, sizes, y)
    for name, at in (("out", (3,)), ("xf", (2, 5)), ("hb", (1, 70)), ("bb", (9,)), ("path", (int(coded[0][0]), 4))):
        old, eps = model.p[name][at], 1e-3
        model.p[name][at] = old + eps
        up, _ = model.gradients(coded, sizes, y)
        model.p[name][at] = old - eps
        down, _ = model.gradients(coded, sizes, y)
        model.p[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-3


# --- 9 Jaccard join


def components_brute(texts, words, num, den):
    docs = [(i, WHITE.findall((t or "").translate(LOWER))) for i, t in texts]
    sets = [{tuple(w[a : a + words]) for a in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()} for _, w in docs]
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                    par[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        least[find(a)] = min(least.get(find(a), i), i) if i is not None else least.get(find(a))
    return collections.Counter((i, len(s), None if i is None else least[find(a)]) for a, ((i, _), s) in enumerate(zip(docs, sets)))


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(spark, words, num):
    texts = fx.awkward()
    got = jaccard_join.near_duplicates(fx.frame(spark, texts), words=words, num=num, den=100).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got) == components_brute(texts, words, num, 100)


def hot_texts(seed=6, n=260):
    """Many documents around one passage, with few words of their own: most segments are shared by all."""
    g = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = g.choices(words, k=60)
    out = []
    for i in range(n):
        own = g.choices(words, k=g.randint(4, 30))
        out.append((i, " ".join(passage + own if i % 2 else own + passage)))
    return out


@pytest.mark.parametrize("minor", [16, 1])
def test_jaccard_join_of_a_hot_passage(spark, monkeypatch, minor):
    monkeypatch.setattr(jaccard_join, "MINOR", minor)
    texts = hot_texts()
    used = []
    allocated = jaccard_join._allocated
    monkeypatch.setattr(jaccard_join, "_allocated", lambda *a: used.append(1) or allocated(*a))
    got = jaccard_join.near_duplicates(fx.frame(spark, texts), words=3, num=80, den=100).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got) == components_brute(texts, 3, 80, 100)
    assert used  # the allocated join was needed


def test_jaccard_join_of_short_hot_texts(spark, monkeypatch):
    """Sets of few shingles, most of them everywhere."""
    monkeypatch.setattr(jaccard_join, "MINOR", 0)
    g = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(["p q r s t u v"] + g.choices(words, k=g.randint(0, 4)))) for i in range(150)]
    got = jaccard_join.near_duplicates(fx.frame(spark, texts), words=3, num=75, den=100).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got) == components_brute(texts, 3, 75, 100)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_duplicates(fx.empty(spark)).count() == 0
    only = jaccard_join.near_duplicates(fx.frame(spark, [(1, None), (2, ""), (None, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in only if r["doc_id"]) == [(1, 1), (2, 2)]


def test_pigeonhole_bounds():
    """Linked sets agree on more segments than may be left out, and sketches never overstate a difference."""
    g, spec = np.random.default_rng(5), jaccard_sets.Spec(4, 85, 100)
    for n in (1, 5, 8, 20, 47, 130, 700, 3000):
        x = np.unique(g.integers(1, 2**63, n).astype(np.uint64))
        for _ in range(10):
            far, y = spec.distance(2 * len(x)), list(x)
            for _ in range(int(g.integers(0, far + 1))):
                if g.random() < 0.5 and len(y) > 1:
                    y.pop(int(g.integers(len(y))))
                else:
                    y.append(np.uint64(g.integers(1, 2**63)))
            y = np.unique(np.array(y, np.uint64))
            inter = len(np.intersect1d(x, y))
            if 100 * inter < 85 * (len(x) + len(y) - inter) or np.array_equal(x, y):
                continue
            w, at = np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)])
            a, b = jaccard_sets.sketches(w, at)
            assert jaccard_sets.sketch_distance(a, b) <= len(x) + len(y) - 2 * inter
            sig, row, (er, es, en) = jaccard_sets.signatures(w, at, spec)
            common = np.intersect1d(sig[row == 0], sig[row == 1])
            scheme = max(np.searchsorted(spec.bounds, len(x), "right"), np.searchsorted(spec.bounds, len(y), "right")) - 1
            both_empty = min([0, 0] if not len(er) else [sum(en[(er == r) & (es == scheme)]) for r in (0, 1)])
            agree = int(((common & np.uint64(63)) == scheme).sum()) + both_empty
            assert agree >= spec.segments(np.array([scheme]))[0] - (len(x) + len(y) - 2 * inter)


# --- 10 packing


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return path, Tokenizer.from_file(path)


ODD = ["", "   ", "\n", "Σ ΑΣ ας", "İstanbul <|endoftext|>x", "<|ENDOFTEXT|> a", "é É ét́", "it's don't I'LL", "a.b,c ... ,, a, b.", "日本語 テスト。", "x y z\tq\x1fk", "½ ² 12a", "ﬁ ŉ ǆ ß ẞ", "à ̀b", ".", ",", "İ.", "🙂 a🙂,", "a\x00b"]


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    path, tok = tokenizer()
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    e, texts = packing.Encoder(path), ODD + [t or "" for _, t in fx.awkward() if not t or len(t) < 20_000]
    for i in range(0, len(texts), 7):
        flat, at = e.encode(texts[i : i + 7])
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in tok.encode_batch(texts[i : i + 7], add_special_tokens=False)]


@pytest.mark.parametrize("capacity,unit", [(4096, 8), (64, 4)])
def test_packing(spark, capacity, unit):
    path, tok = tokenizer()
    texts = [x for x in fx.awkward() if x[0] != 301] + [(400 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(fx.frame(spark, texts), path, capacity=capacity, unit=unit).collect()
    ids = collections.defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    assert pieces == collections.Counter((i, s, len(x[s : s + capacity]), zlib.crc32(x[s : s + capacity].tobytes()), len(x)) for i, xs in ids.items() for x in xs for s in range(0, len(x), capacity))
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    total = sum(n for s in by.values() for _, n in s)
    assert len(by) <= 1.15 * total / capacity + 2
    assert packing.pack(fx.empty(spark), path).count() == 0


def test_cutting_stock_is_near_the_bound():
    g = np.random.default_rng(3)
    for room in (16, 64):
        demand = g.integers(0, 400, room)
        plan = packing.cutting_stock(demand.copy(), room)
        assert (sum(p * n for p, n in plan) == demand).all() and all((p * np.arange(1, room + 1)).sum() <= room for p, _ in plan)
        _, x, price = packing.column_generation(demand, room)
        bound = price @ demand  # no packing needs fewer
        assert packing.best_pattern(price, room)[0] <= 1 + 1e-9 and abs(x.sum() - bound) < 1e-2 * bound
        assert bound - 1e-6 <= sum(n for _, n in plan) <= bound + len(x) / 2 + 1


def test_cutting_stock_beside_a_session():
    """Hundreds of classes in a process that started Spark, where LAPACK's threads may not come back; in a process of
    its own, as a wait inside the library can't be interrupted."""
    demand = np.random.default_rng(5).integers(0, 40, 512)
    code = "from pyspark.sql import SparkSession; SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
    code += f"import numpy as np; from lodestone.llm import packing\nplan = packing.cutting_stock(np.array({demand.tolist()}), 512)\n"
    code += f"assert (sum(p * n for p, n in plan) == np.array({demand.tolist()})).all()"
    root = str(Path(__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=180)


def test_triangular_inverse():
    upper = np.triu(np.random.default_rng(6).integers(0, 3, (60, 60))).astype(float) + 4 * np.eye(60)
    assert np.abs(packing._triangular_inverse(upper) @ upper - np.eye(60)).max() < 1e-8
    assert packing._triangular_inverse(np.zeros((0, 0))).shape == (0, 0)


def test_best_pattern_against_all():
    g = np.random.default_rng(4)
    for _ in range(20):
        price, room = g.random(6), 9

        def best(left, first=0):
            return max([0.0, *(price[i] + best(left - i - 1, i) for i in range(first, 6) if i + 1 <= left)])

        gain, pattern = packing.best_pattern(price, room)
        assert abs(gain - best(room)) < 1e-9 and abs(pattern @ price - gain) < 1e-9


# --- registered queries and the pipeline


def test_contract_columns(spark, sf):
    want = {
        "op1_": ["doc_id", "n_lines", "n_dropped", "kept_sha256"], "op3_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op4_": ["doc_id", "held_out", "score", "predicted"], "op5_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op6_": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op8_": ["page_id", "url", "text", "n_chars"], "op9_": ["doc_id", "n_shingles", "component_id"],
        "op10_": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    }
    for prefix, columns in want.items():
        (name,) = [n for n in queries.QUERIES if n.startswith(prefix)]
        if prefix in ("op3_", "op4_", "op6_", "op8_", "op10_"):
            assert queries.QUERIES[name](spark, sf).columns[: len(columns)] == columns


def test_stages_return_extra_columns_as_they_were(spark, sf):
    import corpus_pipeline as cp

    df = fx.frame(spark, [*fx.awkward(3, 30), *[(400 + i, "one shared line of more than forty characters, said again\nown " + str(i)) for i in range(6)]])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns, name
        assert {r[c] for r in out.select(*fx.EXTRA).distinct().collect() for c in fx.EXTRA} <= {"x"}, name
    assert cp.STAGES[-1][1](spark, df, sf).count() >= df.count()
    dropped = {r["doc_id"]: r for r in cp.STAGES[1][1](spark, df, sf).collect()}
    assert dropped[400]["text"] == "own 0" and dropped[400]["n_chars"] == 5 and "shared" in dropped[405]["text"]


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as cp

    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert all(out[n].columns == before.columns for n, _ in cp.STAGES[:-1])
    rows = lambda n: [(r["doc_id"], r["text"]) for r in out[n].collect()]
    assert sorted((i, t) for i, _, _, t in brute_lines(rows("quality_classifier"))) == sorted(rows("line_dedup"))
    comps = components_brute(rows("line_dedup"), 5, 80, 100)
    assert sorted(i for i, _ in rows("jaccard_join")) == sorted(i for i, _, c in comps if i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [i for (i, _, h, _) in contamination(rows("jaccard_join"), items) if not h]
    assert sorted(i for i, _ in rows("decontamination")) == sorted(clean)
    _, tok = tokenizer()
    tokens = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows("decontamination")}
    got = collections.Counter()
    for r in out["packing"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == tokens
    assert cp.run(spark, sf).count() == out["packing"].count()


