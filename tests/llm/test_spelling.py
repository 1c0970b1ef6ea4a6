import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cohortspark.llm import spelling
from cohortspark.llm.spelling import borders, letters, reach, spelling_variants, vectors

from helpers import docs_frame


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{w}".encode())
                if h % 31 == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, k, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, k in words.items()}


def made(seed, n_docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randint(7, 10))) for _ in range(40)]
    base += ["".join(rng.sample(w, len(w))) for w in base[:20]]  # same letters in other orders
    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 3, 30, 300])
        for _ in range(6):
            i = rng.randrange(len(w))
            pool.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé×") + w[i:], w[:i] + rng.choice("abcdé") + w[i + 1:]]))
    return [(i, " ".join(rng.choice(pool).capitalize() if rng.random() < .2 else rng.choice(pool) for _ in range(rng.randint(0, 200))))
            for i in range(n_docs)]


def rows_of(df):
    return [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]


def test_variants_match_brute_force(spark):
    rows = made(1) + [(500, None), (501, ""), (None, "aaaaaaa aaaaaaab " * 3), (3, "aaaaaaa"), (502, "z" * 30_000 + " " + "z" * 30_000 + " " + "z" * 29_999),
                      (503, "z" * 29_999), (504, "abcdefg " * 30_000),
                      *[(505 + i, "chainaaa chainaaa " + "chainaab " * 30 + "chainabb " * 400 + "chainbbb " * 5000) for i in range(3)]]
    got = rows_of(spelling_variants(docs_frame(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(f is not None for *_, f, _, _ in got) and any(w != r != f for w, _, _, f, _, r in got)
    assert rows_of(spelling_variants(docs_frame(spark, []))) == []


def test_small_boxes_and_tiles_lose_no_pair(spark, monkeypatch):
    rows = made(2)
    want = brute(rows)
    for box, tile in ((8, 1_000_000), (1_000_000, 16), (8, 8)):
        monkeypatch.setattr(spelling, "BOX", box)
        monkeypatch.setattr(spelling, "TILE_ROWS", tile)
        real = spelling.borders
        monkeypatch.setattr(spelling, "borders", lambda v, w, box=box: real(v, w, box, 4))
        assert set(rows_of(spelling_variants(docs_frame(spark, rows)))) == want
        monkeypatch.setattr(spelling, "borders", real)


def test_reach_covers_every_near_vector():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(7)) for _ in range(400)]
    v = vectors(*letters(pa.array(words)))
    tree = borders(v, 1.0, 10, 4)
    home = dict(zip(*(x.tolist() for x in reach(tree, v, 0, 0))))
    go = set(zip(*(x.tolist() for x in reach(tree, v, 1, 1))))
    assert len(set(home.values())) > 20
    for i in range(len(words)):
        for j in range(i):
            if one_edit(words[i], words[j]):
                d = v[j] - v[i]
                q, p = (i, j) if d.argmax() > d.argmin() else (j, i)
                assert (q, home[p]) in go
    assert len(go) < 0.5 * len(words) * len(set(home.values()))
