"""Language ID, quality rules and context mixing: brute-force parts and held-out accuracy."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import langid, mixing, quality
from cohortspark.session import checkpoint_dir

from helpers import docs_frame, texts

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, " \n 123 !!"), (None, "le la les et que pour dans"), (9004, "the of and " * 20_000), (9005, "É")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def with_odd(spark, docs):
    rows = [(i, t, None if i is None else "en", "s", 0) for i, t in ODD]
    odd = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(odd).withColumn("held_out", F.lit("x")).withColumn("n", F.lit("y")).withColumn("log_bytes", F.lit("z"))


# ---------------------------------------------------------------- language ID

def test_codewords_are_distinct_and_far_apart():
    for n in (1, 2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code.tolist()}) == n
        if n >= 4:
            assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) >= 3


def test_languages_on_held_out_rows(spark, tables):
    docs = with_odd(spark, tables[0])
    got = langid.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in tables[0].collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 20
    odd = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is None or r["doc_id"] > 9000}
    assert [odd[9001], odd[9002], odd[9003], odd[None], odd[9004]] == ["und", "und", "und", "fr", "en"] and odd[9005] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_languages_are_not_learned(spark, tables):
    docs = tables[0]
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    key = lambda r: r["doc_id"]
    assert sorted(langid.identify(wrong).collect(), key=key) == sorted(langid.identify(docs).collect(), key=key)


def test_nothing_learned_and_empty(spark):
    assert langid.identify(docs_frame(spark, [])).collect() == []
    got = langid.identify(docs_frame(spark, [(1, "text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


# ---------------------------------------------------------------- quality

def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    got = quality.quality_scores(with_odd(spark, docs), labels).collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    assert auc(held) >= 0.9
    assert len(got) == docs.count() + len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    key = lambda r: r["doc_id"]
    assert sorted(quality.quality_scores(docs, flipped).collect(), key=key) == sorted(quality.quality_scores(docs, labels).collect(), key=key)


def test_quality_without_labels_and_compiled_rules(spark):
    docs = docs_frame(spark, [(1, "a b c"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.quality_scores(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.9 for r in quality.quality_scores(docs, one).collect())
    assert quality.quality_scores(docs_frame(spark, []), none).collect() == []
    kept = [(((0, True, 1.0), (4, False, 0.5)), 2.0), (((1, False, 0.5),), -1.0)]
    row = spark.createDataFrame([(2.0, 3.0, 0.25)], "log_bytes double, log_words double, digits double")
    assert row.select(quality.compile_rules(0.5, kept).alias("s")).first()["s"] == pytest.approx(1 / (1 + math.exp(-2.5)))


# ---------------------------------------------------------------- context mixing

BITS = (12,) * (mixing.N_IN - 1)


def test_base_score_matches_brute_force_and_the_model_learns(spark):
    train = texts(120, 5)
    rows = list(enumerate(train)) + [(500, None), (501, ""), (502, "Unseen wörds, Al be\x0bga"), (None, train[0]), (3, train[3]), (503, "al " * 3000)]
    keep, mixing.HEAD_WORDS = mixing.HEAD_WORDS, 8  # most words take the join
    try:
        got = mixing.mixing_scores(docs_frame(spark, rows), bits=BITS).collect()
    finally:
        mixing.HEAD_WORDS = keep
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows), key=str)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == want
    assert all(r["score"] < 0 for r in got)
    fresh = [r for r in got if r["held_out"] and r["doc_id"] < 120 and r["n_bytes"]]
    assert sum(-r["score"] / math.log10(2) for r in fresh) / sum(r["n_bytes"] for r in fresh) < 3.0


def run_texts(texts, tree, tables, mixer):
    total = np.zeros(len(texts))
    for group in mixing.parts_of(texts):
        owner, prev, symbols, ctx = mixing.encode(group)
        pos, node, bit = tree.decisions(prev, symbols)
        first, last = mixing.blocks_of(owner, pos)
        cost = mixer.run(mixing.gather(tables, tree, ctx, pos, node, BITS), tree.depth[node], bit, first, last, learn=False)
        total += np.bincount(owner[pos[first]], cost, len(texts))
    return total


def test_probabilities_of_a_symbol_sum_to_one():
    """At the start of a block nothing has adapted: the 257 symbols' probabilities add up to 1."""
    rng = np.random.default_rng(1)
    tree = mixing.Tree(rng.integers(0, 100, (256, 257)))
    tables = [rng.normal(size=1 << b).astype(np.float32) for b in BITS]
    refine = rng.uniform(0.1, 0.9, (mixing.DEPTHS, mixing.MAP_BINS)).astype(np.float32)
    weights, trust = (rng.normal(size=(n, mixing.N_IN)).astype(np.float32) for n in (mixing.DEPTHS, mixing.GATES))
    ctx = rng.integers(0, 1 << 32, (len(BITS), 1)).astype(np.uint32)
    for prev in (0, 97):
        total = 0.0
        for s in range(257):
            pos, node, bit = tree.decisions(np.array([prev]), np.array([s]))
            cost = mixing.Mixer(weights, trust, refine).run(mixing.gather(tables, tree, ctx, pos, node, BITS), tree.depth[node], bit,
                                                            np.array([0]), np.array([len(pos)]), learn=False)
            total += 2.0 ** -cost[0]
        assert total == pytest.approx(1, abs=1e-4)


def test_costs_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    docs = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 5, 3000, 70, 2048)]
    tree = mixing.Tree(np.ones((256, 257)))
    tables = [rng.normal(size=1 << b).astype(np.float32) for b in BITS]
    alone = np.concatenate([run_texts([d], tree, tables, mixing.Mixer()) for d in docs])
    assert run_texts(docs, tree, tables, mixing.Mixer()) == pytest.approx(alone, rel=1e-5)


def test_parts_of_a_long_text_keep_their_contexts():
    text = b"some words of a text " * 40_000
    rows = [(i, before, part, last) for g in mixing.parts_of([text]) for i, before, part, last in g]
    assert len(rows) > 1 and b"".join(r[2] for r in rows) == text and [r[3] for r in rows] == [False] * (len(rows) - 1) + [True]
    whole = mixing.encode([(0, b"", text[:mixing.GROUP * 2], False)])[3]
    split = np.concatenate([mixing.encode([r])[3] for r in rows[:2]], axis=1)
    assert (whole[:, :split.shape[1]] == split).mean() > 0.999


def test_mixing_on_an_empty_table(spark):
    assert mixing.mixing_scores(docs_frame(spark, []), bits=BITS).collect() == []


def test_weights_are_learned_on_every_training_document(spark, monkeypatch):
    rows = list(enumerate(texts(120, 7)))
    monkeypatch.setattr(mixing, "WEIGHT_TOKENS", 10, raising=False)
    met, learn = [], mixing.learn_mixer

    def spy(train, tree, *rest):
        met.append((tree, learn(train, tree, *rest)))
        return met[-1][1]

    monkeypatch.setattr(mixing, "learn_mixer", spy)
    mixing.mixing_scores(docs_frame(spark, rows), bits=BITS)
    tree, mixer = met[0]
    want = 0
    for group in mixing.parts_of([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]):
        want += len(tree.decisions(*mixing.encode(group)[1:3])[0])
    assert mixer.done.sum() == want


def test_counts_of_contexts_are_exact_and_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 1000)
    monkeypatch.setattr(mixing, "BUCKET_KEYS", 3000)
    tree, sizes = mixing.Tree(np.ones((256, 257))), []
    for n in (20, 80):
        docs = texts(n, 11)
        want, k = Counter(), mixing.ORDERS[0]
        for t in docs[1:]:
            x = [0] * mixing.PAD + list(t.encode()) + [mixing.END]
            for j in range(mixing.PAD, len(x)):
                _, node, bit = tree.decisions(np.array([x[j - 1]]), np.array([x[j]]))
                want.update((tuple(x[j - k:j]), int(m), int(b)) for m, b in zip(node, bit))
        rows = spark.createDataFrame([(i, i == 0, len(t), t) for i, t in enumerate(docs)],
                                     "doc_id long, held_out boolean, n_bytes long, text string").coalesce(1)
        parts = mixing.in_parts(rows).select("part", "held_out", "text")
        got = mixing.context_counts(parts, tree, mixing.TABLE_BITS).toArrow()
        assert len(set(got["part"].to_pylist())) > 1
        pairs = {}
        for part in set(got["part"].to_pylist()):
            found, c = mixing.part_counts(got.filter(pc.equal(got["part"], part)))
            assert len(found.keys) == len(c) and (np.diff(found.keys) > 0).all()
            for key, x in zip(found.keys.tolist(), c.tolist()):
                assert pairs.setdefault(key, x) == x
        mine = sorted(c for key, c in pairs.items() if key >> mixing.KEY_BITS == 0 and sum(c))
        nodes = {(c, m) for c, m, _ in want}
        assert mine == sorted([want[(*x, 0)], want[(*x, 1)]] for x in nodes)
        sizes.append(len(pairs))
    assert sizes[1] > sizes[0]


def test_weights_and_map_adapt_along_the_whole_document():
    rng = np.random.default_rng(3)
    tree = mixing.Tree(np.ones((256, 257)))
    tables = [rng.normal(size=1 << b).astype(np.float32) for b in BITS]
    refine = np.full((mixing.DEPTHS, mixing.MAP_BINS), 0.5, np.float32)
    phrase = bytes(rng.integers(97, 123, 64).astype(np.uint8))
    costs, whole = [], phrase * 64
    for n in (16, 48, 64):
        mixer = mixing.Mixer(refine=refine)
        costs.append(run_texts([phrase * n], tree, tables, mixer)[0] / n)
        assert all((a != b[:, 0]).any() for a, b in zip(mixer.after, mixer.start(1, None, 0)))
    assert costs[2] < costs[1] < 0.95 * costs[0]  # what is learned is kept over the whole text

    def pieces(cuts):
        mixer, carried, total = mixing.Mixer(refine=refine), None, 0.0
        for a, b in zip(cuts, cuts[1:]):
            owner, prev, symbols, ctx = mixing.encode([(0, whole[max(0, a - mixing.PAD):a], whole[a:b], b == len(whole))])
            pos, node, bit = tree.decisions(prev, symbols)
            total += mixer.run(mixing.gather(tables, tree, ctx, pos, node, BITS), tree.depth[node], bit, *mixing.blocks_of(owner, pos),
                               learn=False, carried=carried)[0]
            carried = mixer.after
        return total

    assert pieces([0, 2048, 4096]) == pytest.approx(pieces([0, 4096]), rel=0.01)


def test_all_context_orders_are_mixed_and_the_map_is_interpolated():
    group = [(0, b"", b"abcdefghijkl", True)]
    other = [(0, b"", b"abcdezghijkl", True)]  # differs six bytes before the last byte
    a, b = (mixing.encode(g)[3][:, 11] for g in (group, other))
    assert len(a) == 5 and (a[:3] == b[:3]).all() and (a[3:] != b[3:]).all()
    assert mixing.STEP == 64
    refine = np.tile(np.linspace(0.1, 0.9, mixing.MAP_BINS, dtype=np.float32), (mixing.DEPTHS, 1))
    weights = np.ones((mixing.DEPTHS, mixing.N_IN), np.float32)
    at = [[0.1 * i for i in (0, 1, 2)], [0.0] * 3]
    costs = [mixing.Mixer(weights, None, refine).run(np.full((mixing.N_IN, 1), x / mixing.N_IN, np.float32), np.zeros(1, np.int64),
                                                     np.ones(1, np.int8), np.array([0]), np.array([1]), learn=False)[0] for x in at[0]]
    plain = [2 * 2.0 ** -c - 1 / (1 + math.exp(-x)) for c, x in zip(costs, at[0])]
    assert plain[0] < plain[1] < plain[2]  # between two bins the map has values in between


def test_scores_do_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 4000)
    docs = docs_frame(spark, list(enumerate(texts(200, 13))) + [(900, "x" * 9000), (901, None), (None, "al be")])
    found = []
    for n in (1, 6):
        rows = mixing.mixing_scores(docs.repartition(n, "text")).collect()
        found.append({(r["doc_id"], r["n_bytes"]): r["score"] for r in rows})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 203
    assert all(found[1][k] == pytest.approx(v, rel=1e-6) for k, v in found[0].items())


def test_an_unbroken_run_keeps_its_word_context_at_a_cut():
    text = bytes(np.random.default_rng(4).integers(97, 123, mixing.GROUP * 2 + 500).astype(np.uint8))
    pieces = [(i, before, part, last) for g in mixing.parts_of([text]) for i, before, part, last in g]
    assert len(pieces) == 3
    whole = mixing.encode([(0, b"", text, True)])[3]
    assert (whole == np.concatenate([mixing.encode([p])[3] for p in pieces], axis=1)).all()


def test_packed_numbers_come_back_whole():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 1 << 55, n))
        counts = np.concatenate([rng.integers(0, 3, (len(keys), 2)), [[2**33, 2**40]]])[:len(keys)]
        assert (np.cumsum(mixing.unpacked(mixing.packed_keys(keys))) == keys).all()
        assert (mixing.unpacked_counts(mixing.packed_counts(counts)) == counts).all()


def test_scratch_tables_take_no_more_than_the_text(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 50_000)
    sizes, keep = {}, mixing.stage

    def spy(df, name):
        out = keep(df, name)
        sizes[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(mixing, "stage", spy)
    rows = list(enumerate(texts(3000, 17)))
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    assert mixing.mixing_scores(docs_frame(spark, rows)).count() == 3000
    assert len({"units", "contexts"} & sizes.keys()) == 2
    assert sum(sizes.values()) < sum(len(t) for _, t in rows)
    left = set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))) - before
    assert not [x for x in left if "units" in x or "contexts" in x]  # nothing reads them any more


def test_scores_do_not_depend_on_what_is_worked_on_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 3000)
    docs = docs_frame(spark, list(enumerate(texts(150, 19))) + [(900, "y" * 7000), (901, None), (901, None)])
    found = []
    for unit, wide, lanes, keys in ((1, 1, 1, 1 << 24), (5, 1 << 19, 3, 9000)):
        for name, x in (("UNIT", unit), ("WIDE", wide), ("LANES", lanes), ("BUCKET_KEYS", keys)):
            monkeypatch.setattr(mixing, name, x)
        found.append(sorted(((r["doc_id"], r["score"]) for r in mixing.mixing_scores(docs).collect())))
    assert [x for x, _ in found[0]] == [x for x, _ in found[1]]
    assert [x for _, x in found[1]] == pytest.approx([x for _, x in found[0]], rel=1e-9)


def test_answers_beyond_own_counts_come_back_whole():
    rng = np.random.default_rng(6)
    tree = mixing.Tree(rng.integers(0, 50, (256, 257)))
    entries = np.unique(rng.integers(0, 40, 4000) << 17 | rng.integers(97, 100, 4000) << 9 | rng.integers(0, 257, 4000))
    times = rng.integers(0, 5, len(entries)) * rng.integers(1, 2**40, len(entries))
    mine = rng.random(len(entries)) < 0.3
    own = np.where(mine, rng.integers(0, times + 1), 0)
    _, whole = next(mixing.paths_of(tree, entries))
    _, part = next(mixing.paths_of(tree, entries[mine]))
    met = np.isin(whole.key, part.key)
    code = whole.coded(whole.counts(times), np.flatnonzero(mine), own[mine])
    assert (part.decoded(*code, part.counts(own[mine])) == whole.counts(times)[met]).all()
