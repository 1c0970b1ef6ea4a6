import numpy as np

from cohortspark.llm.caps import cap_links, cap_plan, decode, unit

from helpers import classes

SCHEMA = "vec_id long, embedding array<float>, label int, n string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA)


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        center = rng.standard_normal(64)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (center + rng.uniform(0.1, 0.45) * rng.standard_normal(64)).tolist(), int(c % 3)))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], rows[0][2]), (1002, [2 * x for x in rows[0][1]], rows[0][2])]
    got = {r["vec_id"]: r for r in cap_links(frame(spark, rows), tile_rows=5).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    root = classes(len(rows), [(int(a), int(b)) for a, b in zip(*np.nonzero(link)) if b < a])
    found = sum(r["n_links"] for r in got.values())
    assert all(got[r[0]]["n_links"] <= link[i].sum() for i, r in enumerate(rows)) and found >= 0.99 * link.sum() > 0
    if found == link.sum():
        assert [got[r[0]]["component_id"] for r in rows] == [rows[j][0] for j in root]
        assert all(got[r[0]]["kept"] == (got[r[0]]["component_id"] == r[0]) for r in rows)


def test_vectors_that_link_with_nothing(spark):
    ok = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, ok, 1), (2, ok, 1), (3, ok, None), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1), (7, [1.0, None, 0.0, 0.0], 1),
            (8, [float("nan"), 0.0, 0.0, 0.0], 1), (9, [float("inf"), 0.0, 0.0, 0.0], 1), (None, ok, 1), (10, [1.0, 0.0], 1), (2, ok, 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cap_links(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *((i, 0, i, True) for i in range(3, 11))], key=str)


def test_a_repeated_vec_id_names_no_node(spark):
    a = np.random.default_rng(1).standard_normal(16)
    b, near = -a, a + 1e-4
    got = cap_links(frame(spark, [(1, b.tolist(), 1), (1, a.tolist(), 1), (3, near.tolist(), 1), (2, b.tolist(), 2)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (3, 1, 1)]


def test_near_copies_close_to_the_threshold_link(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(60):  # a copy of each vector at a cosine of 0.93 to 0.99, and one just below
        v = rng.standard_normal(48)
        v /= np.linalg.norm(v)
        for cos in (1.0, 0.9301 + 0.0598 * (c / 59), 0.9290):
            w = rng.standard_normal(48)
            w -= (w @ v) * v
            w /= np.linalg.norm(w)
            rows.append((len(rows), (cos * v + (1 - cos * cos) ** 0.5 * w).tolist(), 1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cap_links(frame(spark, rows)).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    root = classes(len(rows), [(int(a), int(b)) for a, b in zip(*np.nonzero(link)) if b < a])
    assert link.sum() >= 110
    assert got == {i: (int(link[i].sum()), root[i]) for i in range(len(rows))}


def test_empty_table(spark):
    assert cap_links(frame(spark, [])).collect() == []


def test_decode_lists_every_filter_above_the_height():
    from cohortspark.llm.caps import ROTATIONS, codebook

    x = unit(np.random.default_rng(1).standard_normal((20, 12)))
    height, n = cap_plan(500, 12, 0.93)
    got = set(zip(*(v.tolist() for v in decode(x, n, height))))
    want, first = set(), 0
    for turn in range(ROTATIONS):
        rot, codes, k = codebook(12, -(-n // ROTATIONS), turn)
        y, parts, at = x @ rot, [], 0
        for c in codes:
            parts.append(y[:, at:at + c.shape[1]] @ c.T)
            at += c.shape[1]
        total = parts[0][:, :, None] + parts[1][:, None, :]
        want |= {(int(r), int(first + i * k + j)) for r, i, j in zip(*np.nonzero(total >= height))}
        first += k ** len(codes)
    assert got == want
