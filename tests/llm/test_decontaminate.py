import hashlib
import random
import re

from cohortspark.llm.decontaminate import decontaminate

from helpers import docs_frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            if item is None or not x:
                continue
            for s in range(max(1, len(x) - size + 1)):
                win = x[s:s + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at:at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found.add(str(item))
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_matches_brute_force_in_one_and_many_blocks(spark):
    rng = random.Random(6)
    vocab = ["Ab", "cd", "ef", "gh9", "ÉÈ", "x_y"]
    make = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, make(rng.randint(1, 12))) for i in range(10)] + [(10, ""), (11, None), (None, make(4)), (3, make(5)), (12, "zz"), (13, "zz cd")]
    rows = [(i, make(rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, make(15) + " " + t + " " + make(15)) for i, (_, t) in enumerate(items[:10])]
    rows += [(204, "zz" + " qq" * 40), (200, None), (201, ""), (202, "!!"), (203, "zz"), (None, items[0][1]), (5, "cd zz cd"), (5, "cd zz cd")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(brute(rows, items, 5), key=str)
    for block in (1_000_000, 12):
        got = sorted((tuple(r) for r in decontaminate(docs_frame(spark, rows), bench, size=5, block_words=block).collect()), key=str)
        assert got == want
    assert any(r[5] for r in want) and any(r[2] and not r[5] for r in want)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs_frame(spark, []), bench).collect() == []
    got = decontaminate(docs_frame(spark, [(1, "some words")]), bench).collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(2, 0, 0, False)]
