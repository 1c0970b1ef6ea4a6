"""Embedding near-dedup with spherical-cap filters.

The filter directions form a structured random product code: after a fixed rotation the
dimensions are cut into blocks, each block has k random unit codes, and every combination of
one code per block is a direction. A vector is list-decoded to all directions whose inner
product with it exceeds the cap height; partial sums that cannot reach the height are pruned.
Vectors that share a filter are compared by exact cosine in double precision. A pair is counted
in its smallest common filter only. Large filters are dealt into tiles; a tile emits one row
per linked vector (its count and its root in the tile's spanning forest), never the pairs.

Cap height and code size follow the number of distinct vectors (``cap_plan``): the expected
number of unrelated vectors in a filter stays constant, and the expected number of filters
that a pair at the threshold shares stays ``shared``, so that recall is the same at every size
(a missed pair has probability about exp(-shared)). All vectors are indexed.

Defined results: a vector that is null, empty, zero or holds null or non-finite components,
and one whose label is null, links with nothing (n_links 0, its own component, kept). A null
vec_id gets n_links 0, a null component and kept true. Vectors of other lengths never link.
Repeated rows are vectors of their own; equal vectors of a label are compared once, as one
node with a count. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, components, forest, map_runs, stage, tiles

TILE_ROWS = 1024


#: independent rotations whose product codes share the directions
ROTATIONS = 32


def _tails(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid of heights, density and upper tail of one coordinate of a random unit vector."""
    t = np.linspace(-1, 1, 20001)
    dens = np.maximum(1 - t * t, 1e-300) ** ((dim - 3) / 2)
    dens /= dens.sum()
    return t, dens, np.cumsum(dens[::-1])[::-1]


def cap_plan(n: int, dim: int, threshold: float, shared: float = 14.0, strangers: int = 16) -> tuple[float, int]:
    """(cap height, number of directions) for ``n`` distinct vectors: about ``strangers`` random
    vectors fall into a cap, and a pair at the threshold shares ``shared`` caps on average."""
    dim, r = max(dim, 4), min(threshold, 1 - 1e-6)
    share = min(1 / 64, strangers / max(n, 1))
    t, dens, tail = _tails(dim)
    height = float(np.interp(-share, -tail, t))
    s = np.linspace(height, 1, 4001)[:-1]
    w = (1 - s * s) ** ((dim - 3) / 2)
    u, _, rest = _tails(dim - 1)
    both = np.interp((height - r * s) / np.sqrt((1 - r * r) * (1 - s * s)), u, rest)
    joint = float((w * both).sum() / w.sum())
    return height, math.ceil(shared / joint / share)


def codebook(dim: int, directions: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(rotation, codes of each block, codes per block): at most 1024 codes per block."""
    m = 1
    while m < 2 or math.ceil(directions ** (1 / m)) > 1024:
        m += 1
    m = max(1, min(m, dim))
    k = max(2, math.ceil(directions ** (1 / m)))
    rng = np.random.default_rng([seed, dim, k])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    codes = []
    for part in np.array_split(np.arange(dim), m):
        c = rng.standard_normal((k, len(part)))
        codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(m))
    return turn, codes, k


def _decode_one(x: np.ndarray, book, height: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) with inner product >= height, for unit rows ``x``."""
    turn, codes, k = book
    y, at, scores = x @ turn, 0, []
    for c in codes:
        scores.append(y[:, at:at + c.shape[1]] @ c.T)
        at += c.shape[1]
    rest = np.zeros((len(codes) + 1, len(x)))
    for j in range(len(codes) - 1, -1, -1):
        rest[j] = rest[j + 1] + scores[j].max(axis=1)
    row, code, acc = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for j, s in enumerate(scores):
        rows, ids, sums = [], [], []
        for i in range(0, len(row), 8192):
            r, total = row[i:i + 8192], acc[i:i + 8192, None] + s[row[i:i + 8192]]
            p, q = np.nonzero(total + rest[j + 1][r][:, None] >= height)
            rows.append(r[p]); ids.append(code[i:i + 8192][p] * k + q); sums.append(total[p, q])  # noqa: E702
        row, code, acc = (np.concatenate(v) if v else np.zeros(0, t) for v, t in
                          ((rows, np.int64), (ids, np.int64), (sums, float)))
    return row, code


def decode(x: np.ndarray, directions: int, height: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, filter) over the independent rotations, sorted by row and filter."""
    rows, codes, first = [], [], 0
    for turn in range(ROTATIONS):
        book = codebook(x.shape[1], -(-directions // ROTATIONS), turn)
        row, code = _decode_one(x, book, height)
        rows.append(row)
        codes.append(code + first)
        first += book[2] ** len(book[1])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    return row[order], code[order]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _describe(batch: pa.RecordBatch) -> dict:
    valid, digest = [], []
    for v in batch.column("embedding"):
        a = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False)
        ok = a is not None and len(a) > 0 and bool(np.isfinite(a).all()) and bool(a.any())
        valid.append(ok)
        digest.append(hashlib.blake2b((a + 0.0).tobytes(), digest_size=16).digest() if ok else None)
    return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "valid": valid, "digest": digest}


def cap_links(vectors: DataFrame, threshold: float = 0.93, shared: float = 14.0, strangers: int = 16,
              tile_rows: int = TILE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding",
              label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("embedding"))
    members = stage(arrow_map(src, _describe, "vec_id long, label string, valid boolean, digest binary"), "vecs")
    good = members.where("valid and label is not null and vec_id is not null")
    # a node is a distinct vector of a label; its number is its own, also where a vec_id repeats
    nodes = stage(good.groupBy("label", "digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("id", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()

    # the vector of each node, by its smallest vec_id, with the filters it falls into
    one = src.join(nodes.select("vec_id", "id", "label", "digest", "copies"), ["vec_id", "label"])

    def assign(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("id", "label", "copies", "dim", "vec", "filters")}
        keep = [i for i, (ok, d, want) in enumerate(zip(*(
            _describe(batch)[c] for c in ("valid", "digest")), batch.column("digest").to_pylist())) if ok and d == want]
        t = batch.take(pa.array(keep, pa.int64()))
        dims = np.array([len(v) for v in t.column("embedding")], int)
        for dim in np.unique(dims):
            part = t.take(pa.array(np.flatnonzero(dims == dim)))
            x = unit(part.column("embedding").flatten().to_numpy().reshape(-1, dim))
            height, directions = cap_plan(n, int(dim), threshold, shared, strangers)
            row, code = decode(x, directions, height)
            cuts = np.searchsorted(row, np.arange(len(x) + 1))
            for c, src_c in (("id", "id"), ("label", "label"), ("copies", "copies")):
                out[c] += part.column(src_c).to_pylist()
            out["dim"] += [int(dim)] * len(x)
            out["vec"] += [v.tobytes() for v in x]
            out["filters"] += [code[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    coded = stage(arrow_map(one, assign, "id long, label string, copies long, dim int, vec binary, "
                                         "filters array<long>").dropDuplicates(["id"]), "caps")
    key = F.xxhash64("label", "dim", "f").alias("bucket")
    rows = coded.select("id", "label", "copies", "dim", "vec", "filters", F.explode("filters").alias("f")).select("*", key)
    sizes = coded.select("label", "dim", F.explode("filters").alias("f")).select(key).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"))

    def verify(run: pa.Table) -> dict | None:
        col = {c: run.column(c).chunk(0) for c in run.column_names}
        dims, chunk = col["dim"].to_numpy(), col["chunk"].to_numpy()
        if (dims != dims[0]).any():  # two buckets with one hash
            parts = [verify(run.filter(pa.array(dims == d)).combine_chunks()) for d in np.unique(dims)]
            parts = [p for p in parts if p]
            return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None
        n, at = len(run), np.frombuffer(col["vec"].buffers()[1], np.int32)[col["vec"].offset]
        x = np.frombuffer(col["vec"].buffers()[2], np.float64, n * dims[0], int(at)).reshape(n, -1)
        ta, tb = col["ta"][0].as_py(), col["tb"][0].as_py()
        if ta == tb:
            left = right = np.arange(n)
            p, q = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left, right = np.flatnonzero(chunk == ta), np.flatnonzero(chunk == tb)
            p, q = np.nonzero(x[left] @ x[right].T >= threshold)
        if not len(p):
            return None
        p, q = left[p], right[q]
        f, labels = col["f"].to_numpy(), col["label"].dictionary_encode().indices.to_numpy()
        same = (labels[p] == labels[q]) & (f[p] == f[q])
        p, q = p[same], q[same]
        # a pair counts in the smallest filter that it shares
        used = np.unique(np.concatenate([p, q]))
        place = np.searchsorted(used, np.arange(n))
        first, values = col["filters"].offsets.to_numpy(), col["filters"].values.to_numpy()
        size = (first[1:] - first[:-1])[used]
        rr = np.repeat(np.arange(len(used)), size)
        ff = values[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[used], size)]
        less = ff < f[used][rr]
        rr, ff = rr[less], ff[less]
        names, key = np.unique(ff, return_inverse=True)
        seen = np.zeros((len(used), len(used)), bool)
        for i in range(0, len(names), 4096):
            own = (key >= i) & (key < i + 4096)
            has = np.zeros((len(used), min(4096, len(names) - i)), np.float32)
            has[rr[own], key[own] - i] = 1
            seen |= (has @ has.T) > 0
        new = ~seen[place[p], place[q]]
        p, q = p[new], q[new]
        if not len(p):
            return None
        ids, copies = col["id"].to_numpy(), col["copies"].to_numpy()
        links = np.bincount(p, copies[q], n) + np.bincount(q, copies[p], n)
        root = forest(p, q, n)
        hit = np.flatnonzero(links)
        return {"id": ids[hit], "n": links[hit].astype(np.int64), "root": ids[root[hit]]}

    found = stage(map_runs(tiles(rows, sizes.where(F.col("n") > tile_rows), "id", tile_rows), verify,
                           "id long, n long, root long"), "links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = stage(nodes.join(counted, "id", "left").join(comp, "id", "left").select(
        "label", "digest", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("root")), "named")
    smallest = stage(named.groupBy("root").agg(F.min("vec_id").alias("component")), "smallest")
    of_node = named.join(smallest, "root").select("label", "digest", "n_links", "component")
    bad = ~F.coalesce(F.col("valid") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    out = members.withColumn("digest", F.when(~bad, F.col("digest"))).join(of_node, ["label", "digest"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
