import random

import numpy as np
import xxhash

from cohortspark.llm.common import components
from cohortspark.llm.simhash import fingerprint, fingerprints, hamming_links, simhash_classes

from helpers import classes, docs_frame, texts


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_brute_force():
    for t in [*texts(60, 1), "", None, " \n", "One", "ONE two", "a b c", "É é x y z w"]:
        assert fingerprint(t.encode() if t is not None else None, 3) == brute_fingerprint(t)


def test_fingerprint_agrees_with_spark_hash(spark):
    assert spark.sql("select xxhash64('al be ga')").first()[0] == np.uint64(fingerprint(b"al be ga", 3)).astype(np.int64)


def test_classes_match_brute_force(spark):
    rng = random.Random(2)
    base = texts(12, 3, length=120)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "zz"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " "), (7, base[7]), (None, base[0]), (203, base[1])]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_classes(docs_frame(spark, rows), tile_rows=4).collect()}
    keyed = [(i, t) for i, t in rows if i is not None]
    fp = [brute_fingerprint(t) for _, t in keyed]
    links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3 or keyed[a][0] == keyed[b][0]]
    root = classes(len(fp), links)
    small = {}
    for r, (i, _) in zip(root, keyed):
        small[r] = min(small.get(r, i), i)
    for r, (i, _), f in zip(root, keyed, fp):
        assert got[(i, f"{f:016x}")] == small[r]
    assert got[(None, f"{fp[0]:016x}")] is None
    assert len(set(small.values())) < len({i for i, _ in keyed})


def test_links_at_exactly_three_bits_over_tiles(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(200)} | {center})
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    for tile in (8, 1000):
        links = hamming_links(spark.createDataFrame(rows, "id long, fp long"), 3, tile)
        got = {r["id"]: r["component"] for r in components(links).collect()}
        want = classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_empty_table(spark):
    empty = docs_frame(spark, [])
    assert simhash_classes(empty).collect() == []
    assert fingerprints(empty).columns == ["doc_id", "fp"]


def test_components_of_a_long_path(spark):
    n = 300
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)}
