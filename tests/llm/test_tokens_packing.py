import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from cohortspark.llm.common import scratch
from cohortspark.llm.packing import best_fit_packing, piece_bounds, plan_slots
from cohortspark.llm.tokens import Encoder, cuttable, read_model, token_counts

from helpers import docs_frame, texts

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a\t b", "a\t", "  a  b ", "x<|endoftext|>y <|endoftext|>  z", "a\x1c b\x1c", "\t\tx\n\n\ny  \n", "l'été  d'or\r\n x",
       "　a 　b", "é" * 50 + " " * 7 + "'s 's", "1 2  33 !! !!  a", "word.word,word", "Ab\nCd\n\nEf \n", "! \n\x1c"]


def library(path, rows):
    model, kind = read_model(path)
    if kind == "json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.decode())
        return [t.encode(x or "", add_special_tokens=False).ids for x in rows]
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [t.encode(x or "") for x in rows]


def test_pieces_give_the_library_ids():
    rng = random.Random(1)
    letters = [" ", "\n", "\t", "a", "B", "é", "1", "!", "'s", " ", "　", "\x1c", "\x85", "<|endoftext|>", "\r", "​", "᠎", "_", "ß"]
    rows = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    model, kind = read_model(BPE)
    assert cuttable(model) and not cuttable(read_model(public_tokenizers.path("word_bpe_49k.json"))[0])
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(model, kind).ids(rows)]
    assert got == library(BPE, rows)


def test_counts_and_cache(spark):
    rows = [(i, t) for i, t in enumerate(ODD + texts(30, 3))] + [(900, None), (901, ODD[5]), (None, "no id"), (3, ODD[3]), (902, "x " * 20_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path, cache = public_tokenizers.path(name), scratch(spark, "test-cache")
        want = sorted(((i, len((t or "").encode()), len(x), len(x) > 10) for (i, t), x in zip(rows, library(path, [t for _, t in rows]))), key=str)
        token_counts(docs_frame(spark, rows[:20]), path, cache, limit=10)
        for _ in range(2):  # the rest, then nothing new
            got = sorted((tuple(r) for r in token_counts(docs_frame(spark, rows), path, cache, limit=10).collect()), key=str)
            assert got == want
            assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts(docs_frame(spark, []), BPE).collect() == []


def best_fit_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        insort(rooms, room - n)
    return len(rooms)


def test_plan_equals_best_fit_by_document():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        counts, sequences = Counter(), {}
        for n, a, b, first, each, offset in plan_slots(Counter(lengths), capacity):
            for i in range(b - a):
                sequences.setdefault(first + i // each, []).append((offset + i % each * n, n))
            counts[n] += b - a
        assert counts == Counter(lengths)
        for places in sequences.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end = at + n
            assert end <= capacity
        assert len(sequences) == best_fit_bins(lengths, capacity)


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD + texts(60, 9, length=30))] + [(900, None), (None, "no id"), (3, ODD[3]), (902, "long text " * 200)]
    got = [r.asDict() for r in best_fit_packing(docs_frame(spark, rows), BPE, capacity=64, end_id=0).collect()]
    left = Counter()
    for (i, _), ids in zip(rows, library(BPE, [t for _, t in rows])):
        raw = np.array([*ids, 0], "<u4").tobytes()
        for k, (s, n) in enumerate(piece_bounds(len(raw) // 4, 64)):
            left[(i, k, s, n, zlib.crc32(raw[4 * s:4 * (s + n)]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == left
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end = at + n
        assert end <= 64
    assert len(sequences) == best_fit_bins([r["length"] for r in got], 64)
    assert best_fit_packing(docs_frame(spark, []), BPE).collect() == []


def test_pieces_cover_the_ids():
    for n in (1, 5, 64, 65, 128, 129, 1000):
        bounds = piece_bounds(n, 64)
        assert [s for s, _ in bounds] == [sum(k for _, k in bounds[:i]) for i in range(len(bounds))]
        assert sum(k for _, k in bounds) == n and all(k == 64 for _, k in bounds[1:]) and bounds[0][1] <= 64


def test_crc_of_doc_id_as_text(spark):
    from cohortspark.llm.common import crc_fold

    got = spark.range(50).select("id", crc_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
