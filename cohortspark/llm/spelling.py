"""Spelling variant grouping: k-d trees over letter-count vectors.

Words are counted by Spark. One replaced letter moves a word's letter counts by one up and one down,
one inserted letter by one up, so that one edit gives an L1 distance of at most two. For each pair of
lengths (L, L) and (L, L + 1) the near words are found by range searches:

* A k-d tree per length, fitted on a bounded sample of the words (the ``SAMPLE`` words of smallest
  hash), deals the space into boxes of about ``BOX`` words. Every word goes to the box it lies in, and as
  a query to each other box of its length and of the next one that its up and down moves can reach. The
  sample only draws the borders: which pairs are found does not depend on it.
* In a box a second k-d tree with tight bounds prunes the queries; the words in the leaves that remain
  are compared by their counts, and the letter order of what is left is verified exactly.

A box that has more than ``TILE_ROWS`` rows (words with the same letters cannot be split) is dealt into
tiles. Counts are per letter a to z, and six more for the other letters together; counts above 255 stay
255. Both only make a distance smaller, so no pair is lost.

Defined results: null or empty text has no words; a null doc_id damages no word; repeated rows count
as often as they occur; very long texts and runs are taken whole; of near words with equal counts the
smallest in code-point order is the form; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, map_runs, stage, table, tiles  # noqa: F401

#: words that the borders of the boxes are drawn from
SAMPLE = 65_536
#: words that a box should hold
BOX = 16_384
#: rows (words and queries) of one tile
TILE_ROWS = 131_072
#: words of a leaf inside a box
LEAF = 24
#: queries compared with a leaf at a time
QUERIES = 4_096

DIMS = 32
# the count that each letter (a Latin-1 byte) belongs to
_DIM = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)], np.int64)


# ------------------------------------------------------------------ words

def word_counts(docs: DataFrame, least: int = 7, times: int = 2, damage: int = 31, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """(word, n): the runs of letters, A-Z lower-cased, of at least ``least`` code points and ``times``
    occurrences. A run whose crc32 with its doc_id is divisible by ``damage`` loses one code point."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.translate(text_col, upper, lower), F.lit("[a-z\\u00C0-\\u00FF]{%d,}" % least), 0)
    x = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(runs).alias("w"))
    x = x.select("w", F.crc32(F.concat("_id", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    x = x.select(F.when(F.col("h") % damage == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w"))))
                 .otherwise(F.col("w")).alias("word"))
    return x.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' Latin-1 bytes end to end, and their lengths."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def vectors(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letter counts of each word."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(row * DIMS + _DIM[flat], minlength=len(sizes) * DIMS).reshape(-1, DIMS)
    return np.minimum(counts, 255).astype(np.int16)


# ------------------------------------------------------------------ borders of the boxes

def best_cut(v: np.ndarray) -> tuple[int, int, int]:
    """(dimension, cut, smaller side) of the most even split: left is <= cut."""
    best = (0, 0, 0)
    for d in range(DIMS):
        below = np.cumsum(np.bincount(v[:, d]))[:-1]
        if len(below):
            side = np.minimum(below, len(v) - below)
            c = int(side.argmax())
            if side[c] > best[2]:
                best = (d, c, int(side[c]))
    return best


def borders(v: np.ndarray, weight: float, box: int = BOX, least: int = 64) -> list[tuple[int, int, int, int]]:
    """The tree of one length: rows (dimension, cut, left, right); a leaf is (-1, its number, 0, 0). Each
    sample vector stands for ``weight`` words."""
    tree: list = [None]
    todo, leaves = [(0, v)], 0
    while todo:
        at, part = todo.pop()
        d, c, side = best_cut(part) if len(part) * weight > box and len(part) >= least else (0, 0, 0)
        if not side:
            tree[at] = (-1, leaves, 0, 0)
            leaves += 1
            continue
        tree[at] = (d, c, len(tree), len(tree) + 1)
        tree += [None, None]
        low = part[:, d] <= c
        todo += [(tree[at][2], part[low]), (tree[at][3], part[~low])]
    return tree


def reach(tree: list, v: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for each leaf that a vector of ``v`` can reach by ``up`` counts one higher and ``down``
    counts one lower (0 or 1 each). A border that a vector fails by one uses up the move; with both moves
    only the way whose up dimension is not below its down dimension is taken (the other word of a
    pair takes the other way)."""
    rows, leaves = [], []
    n = len(v)
    todo = [(0, np.arange(n), np.full(n, -1), np.full(n, -1))]
    while todo:
        at, idx, u, w = todo.pop()
        if not len(idx):
            continue
        d, c, left, right = tree[at]
        if d < 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), c))
            continue
        here = v[idx, d] + (u == d) - (w == d)
        for child, miss, used, is_up in ((left, here - c, w, False), (right, c + 1 - here, u, True)):
            pays = miss == 1
            fits = (miss <= 0) | (pays & (used < 0) & bool(up if is_up else down))
            u2, w2 = u[fits], w[fits]
            paid = pays[fits]
            if is_up:
                u2 = np.where(paid, d, u2)
            else:
                w2 = np.where(paid, d, w2)
            go = (u2 < 0) | (w2 < 0) | (u2 >= w2)
            todo.append((child, idx[fits][go], u2[go], w2[go]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (none, none)


def bucket_of(size: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    return (size.astype(np.int64) << 24) | leaf.astype(np.int64)


def deal(words: DataFrame) -> DataFrame:
    """Rows (bucket, word, n, kind): kind 0 a word in its box, 1 a query to another box of its length,
    2 a query to a box of the next length."""
    sample = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word").toArrow()["word"].combine_chunks()
    flat, sizes = letters(sample)
    v, weight = vectors(flat, sizes), words.count() / max(1, len(sizes))
    trees = {int(k): borders(v[sizes == k], weight) for k in np.unique(sizes)}
    whole = [(-1, 0, 0, 0)]

    def run(batch: pa.RecordBatch) -> dict:
        col = batch.column("word")
        flat, sizes = letters(col)
        v = vectors(flat, sizes)
        rows, buckets, kinds = [], [], []

        def add(idx, found, size, kind):
            rows.append(idx)
            buckets.append(bucket_of(np.full(len(idx), size), found))
            kinds.append(np.full(len(idx), kind, np.int32))

        for k in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == k)
            tree = trees.get(k, whole)
            r, home = reach(tree, v[own], 0, 0)
            add(own[r], home, k, 0)
            at = np.empty(len(own), np.int64)
            at[r] = home
            if len(tree) > 1:
                r, leaf = reach(tree, v[own], 1, 1)
                other = leaf != at[r]
                add(own[r[other]], leaf[other], k, 1)
            r, leaf = reach(trees.get(k + 1, whole), v[own], 1, 0)
            add(own[r], leaf, k + 1, 2)
        idx = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"bucket": cat(buckets, np.int64), "word": col.take(pa.array(idx)), "n": batch.column("n").take(pa.array(idx)),
                "kind": cat(kinds, np.int32)}

    return arrow_map(words.select("word", "n"), run, "bucket long, word string, n long, kind int", rows=8192)


# ------------------------------------------------------------------ searches inside a box

class BoxTree:
    """k-d tree with the bounds of each node; ``search`` yields (queries, words) candidate arrays."""

    def __init__(self, v: np.ndarray):
        self.v, self.nodes = v, []
        self.build(np.arange(len(v)))

    def build(self, root: np.ndarray) -> None:
        todo = [(root, -1, 0)]
        while todo:
            idx, parent, slot = todo.pop()
            part = self.v[idx]
            d, c, side = best_cut(part) if len(idx) > LEAF else (0, 0, 0)
            at = len(self.nodes)
            self.nodes.append([part.min(0), part.max(0), None if side else idx, 0, 0])
            if parent >= 0:
                self.nodes[parent][3 + slot] = at
            if side:
                low = part[:, d] <= c
                todo += [(idx[low], at, 0), (idx[~low], at, 1)]

    def search(self, q: np.ndarray, down: int):
        """Words whose counts are at most one above (in sum) and ``down`` below those of the query."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, idx = todo.pop()
            low, high, words, left, right = self.nodes[at]
            x = q[idx]
            near = (np.maximum(low - x, 0).sum(1) <= 1) & (np.maximum(x - high, 0).sum(1) <= down)
            idx = idx[near]
            if not len(idx):
                continue
            if words is None:
                todo += [(left, idx), (right, idx)]
                continue
            # words with the same letters are one leaf, however many they are
            for i in range(0, len(idx), QUERIES):
                some = idx[i:i + QUERIES]
                for j in range(0, len(words), QUERIES):
                    block = words[j:j + QUERIES]
                    step = max(1, (1 << 22) // (len(block) * DIMS))
                    for s in range(0, len(some), step):
                        diff = self.v[block][None] - q[some[s:s + step]][:, None]
                        a, b = np.nonzero((np.maximum(diff, 0).sum(2) <= 1) & (np.maximum(-diff, 0).sum(2) <= down))
                        if len(a):
                            yield some[s:s + step][a], block[b], diff[a, b]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where ``b`` is ``a`` with one letter more: common prefix and suffix cover ``a``."""
    prefix = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    suffix = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return prefix + suffix >= a.shape[1]


def near_in_run(rows: pa.Table) -> dict | None:
    """Near pairs (a, an, b, bn) among the rows of one tile, each pair once."""
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    kind, chunk = rows.column("kind").to_numpy(), rows.column("chunk").to_numpy()
    same_chunk = rows.column("ta")[0].as_py() == rows.column("tb")[0].as_py()
    flat, sizes = letters(rows.column("word").combine_chunks())
    v = vectors(flat, sizes)
    starts = np.cumsum(sizes) - sizes
    points = np.flatnonzero(kind == 0)
    if not len(points):
        return None
    size = int(sizes[points[0]])
    spell = lambda idx, k: flat[starts[idx][:, None] + np.arange(k)]
    tree = BoxTree(v[points])
    left, right = [], []
    for queries, down in ((np.flatnonzero(kind < 2), 1), (np.flatnonzero(kind == 2), 0)):
        if not len(queries):
            continue
        for q, p, diff in tree.search(v[queries], down):
            q, p = queries[q], points[p]
            if not same_chunk:
                ok = chunk[q] != chunk[p]
                q, p, diff = q[ok], p[ok], diff[ok]
            if down:  # a pair is found from both words: keep the way up > down, else by the row
                up, low = diff.argmax(1), diff.argmin(1)
                moved = (diff != 0).any(1)
                ok = np.where(moved, up > low, (q != p) & ((kind[q] == 1) | (q < p)))
                q, p = q[ok], p[ok]
            if not len(q):
                continue
            step = max(1, (1 << 22) // size)
            for s in range(0, len(q), step):
                a, b = q[s:s + step], p[s:s + step]
                ok = one_replaced(spell(a, size), spell(b, size)) if down else one_inserted(spell(a, size - 1), spell(b, size))
                left.append(a[ok])
                right.append(b[ok])
    if not left:
        return None
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return None
    names = np.array(words, object)
    return {"a": names[a], "an": n[a], "b": names[b], "bn": n[b]}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): words at one edit, each pair once."""
    dealt = stage(deal(words), "boxes")
    large = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_ROWS)
    x = tiles(dealt, large, "word", TILE_ROWS)
    return map_runs(x, near_in_run, "a string, an long, b string, bn long")


# ------------------------------------------------------------------ forms and roots

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed to the last, doubling the way in
    each round. A form has at least ten times the word's count, so that ways are short and end."""
    cur = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        nxt = stage(cur.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                        F.col("_next").isNotNull().alias("moved")), "roots")
        cur = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return cur


def spelling_variants(docs: DataFrame, ratio: int = 10, least: int = 7, times: int = 2, damage: int = 31) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stage(word_counts(docs, least, times, damage), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")))).alias("x")).select("x.*")
    every = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(both)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), "near")))
    per = every.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("b"))
    fits = F.coalesce(-F.col("b.m") >= ratio * F.col("n"), F.lit(False))
    forms = stage(per.select("word", "n", "n_near", F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
