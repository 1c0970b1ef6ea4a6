import random

import numpy as np

from cohortspark.llm.lines import dedup_lines, line_classes, line_keys, within

from helpers import classes, docs_frame


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def points(s):
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def edited(rng, s, n):
    b = list(s)
    for _ in range(n):
        i, how = rng.randrange(len(b) + 1), rng.randrange(3)
        if how == 0 or i == len(b):
            b.insert(i, rng.choice("abé"))
        elif how == 1:
            b[i] = rng.choice("abé")
        elif len(b) > 1:
            del b[i]
    return "".join(b)


def test_banded_distance_and_shared_keys_against_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 14)))
        b = edited(rng, a, rng.randint(0, 4))
        for e in (1, 2, 3):
            near = distance(a, b) <= e
            assert within(points(a), points(b), e) == near
            if near and min(len(a), len(b)) > e:
                assert set(line_keys(a, e)) & set(line_keys(b, e))


def sample(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(22, 60))).strip() for _ in range(25)]
    rows = []
    for i in range(30):
        lines = [edited(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(1, 5))] + ["short", ""]
        rows.append((i, "\n".join(lines)))
    return rows


def test_classes_and_dropped_lines_match_brute_force(spark):
    rows = sample(4)
    places = [(i, k, line.strip()) for i, t in rows for k, line in enumerate(t.split("\n")) if len(line.strip()) >= 20]
    want = classes(len(places), [(a, b) for a in range(len(places)) for b in range(a) if distance(places[a][2], places[b][2]) <= 2])
    for tile in (3, 512):
        got = {(r["doc_id"], r["line_no"]): bytes(r["class"]) for r in line_classes(docs_frame(spark, rows), tile_rows=tile).collect()}
        assert len(got) == len(places)
        ours = [got[(i, k)] for i, k, _ in places]
        assert len(set(ours)) == len(set(want)) == len(set(zip(ours, want)))
    gone = {(i, k) for n, (i, k, _) in enumerate(places) if want[n] != n}
    kept = {r["doc_id"]: r for r in dedup_lines(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        left = [line for k, line in enumerate(t.split("\n")) if (i, k) not in gone]
        if i not in {d for d, _ in gone} or any(len(x.strip()) >= 20 for x in left):
            assert kept[i]["text"] == "\n".join(left) and kept[i]["dropped"] == sum(i == d for d, _ in gone)
        else:
            assert i not in kept


def test_null_empty_repeated_and_long_rows(spark):
    line = "a line that stands in several documents"
    rows = [(1, line + "\nown words of the first document"), (2, line), (2, line), (3, None), (4, ""), (None, line), (5, "x" * 200_000),
            (6, line + "\n" + line + "s\nsomething else that is not repeated"), (7, "tiny\ntiny")]
    got = dedup_lines(docs_frame(spark, rows))
    assert "class" in got.columns and "row" in got.columns
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by == {1: [rows[0][1]], 3: [None], 4: [""], None: [line], 5: ["x" * 200_000],
                  6: ["something else that is not repeated"], 7: ["tiny\ntiny"]}
    assert dedup_lines(docs_frame(spark, [])).collect() == []
    assert line_classes(docs_frame(spark, [])).collect() == []


def test_a_document_of_own_short_lines_is_kept(spark):
    line = "a boilerplate line that stands in several documents"
    rows = [(1, line + "\nmilk\neggs"), (2, line + "\nroses\n are red "), (3, "roses\n" + line + "\n \nmilk"), (4, line + "\nare red\nviolets"),
            (5, line + "\n \t"), (6, "violets\nand more"), (None, line + "\nviolets")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "roses\n are red ", 4: "are red\nviolets", 6: rows[5][1], None: rows[6][1]}
