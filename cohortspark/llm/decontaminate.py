"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of an item (an item of fewer words is one window). Its
word shingles are ordered by how often they occur in all documents; as a window must occur
whole, its necessary prefix is one shingle, the rarest. Documents are probed for those shingles;
a probe's position bounds the window's start, the lengths bound its end, and the words in
between are compared. The benchmark goes to the executors in blocks of at most ``block_words``
words, one after the other, so any benchmark size works; documents are never shuffled.

Defined results: null or empty text has no words (n_words 0, not contaminated); a null doc_id
keeps its row; repeated document rows each get a row; items without words or without an
item_id have no windows; rows that repeat an item_id are one item; extra columns are ignored;
empty tables give an empty result or clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import Shared, arrow_map, binary_texts, row_key
from cohortspark.llm.words import words_of

#: words per shingle
SHINGLE = 3


class Windows:
    """The distinct windows of one block of items, as word numbers of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for s in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[s:s + size]), set()).add(item)
        self.size, self.items = size, [sorted(x) for x in found.values()]
        self.length = np.array([len(w) for w in found], np.int64)
        self.words = np.full((len(found), size), -2, np.int64)
        for i, w in enumerate(found):
            self.words[i, :len(w)] = w
        # every shingle place of every window: (shingle length, code, window, offset)
        place = []
        for n in range(1, SHINGLE + 1):
            own = np.flatnonzero(self.length >= SHINGLE if n == SHINGLE else self.length == n)
            for off in range(size - n + 1):
                w = own[self.length[own] >= off + n]
                if len(w):
                    code = self.code([self.words[w, off + k] for k in range(n)])
                    place.append(np.stack([np.full(len(w), n), code, w, np.full(len(w), off)], axis=1))
        self.place = np.concatenate(place) if place else np.zeros((0, 4), np.int64)
        self.sizes = [int(n) for n in np.unique(self.place[:, 0])]

    def code(self, cols: list[np.ndarray]) -> np.ndarray:
        out, bad = cols[0].astype(np.int64), cols[0] < 0
        for c in cols[1:]:
            out, bad = out * (len(self.vocab) + 1) + c, bad | (c < 0)
        out[bad] = -1
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))

    def probes(self, ids: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key number) where a shingle of ``n`` words has one of the sorted ``keys``."""
        if len(ids) < n or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        at = known[:len(ids) - n + 1].copy()
        for k in range(1, n):
            at &= known[k:len(ids) - n + 1 + k]
        at = np.flatnonzero(at)
        code = self.code([ids[at + k] for k in range(n)])
        i = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        same = keys[i] == code
        return at[same], i[same]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks; one block at a time is held by the driver."""
    bound = items.select((F.sum(F.length("text") + 1)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-bound // (2 * block_words)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        got = items.where(part == b).distinct().orderBy("item_id", "text").collect() if bound else []
        yield [(r["item_id"], r["text"].encode()) for r in got]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, ratio: int = 20,
                  block_words: int = 1_000_000, text_col: str = "text", id_col: str = "doc_id", with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, row (its ``row_key``, on demand), n_words, n_hit, n_items, items_sha256, contaminated
    (n_hit > 0 and ratio * n_hit >= n_words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(
        "item_id is not null and text is not null")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", row_key())
    none = F.array().cast("array<long>")
    state = src.select("*", none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    for block in _blocks(items, block_words):
        win = Shared(spark, Windows(block, size))
        state = _probe(state, win, _rarest(src, win))
    out = _summary(state.drop("text"), ratio)
    return out if with_row else out.drop("row")


def _rarest(src: DataFrame, win) -> dict[int, tuple]:
    """For each shingle length the prefix shingles: sorted codes, and the (window, offset) of each."""
    w = win.value
    keys = {n: np.unique(w.place[w.place[:, 0] == n, 1]) for n in w.sizes}
    first = {n: sum(len(keys[m]) for m in w.sizes if m < n) for n in w.sizes}

    def count(batch: pa.RecordBatch) -> dict:
        total = np.zeros(sum(map(len, keys.values())), np.int64)
        for t in (t for i in range(0, batch.num_rows, 512) for t in binary_texts(batch.column("text").slice(i, 512))):
            ids = win.value.ids(words_of(t))
            for n, k in keys.items():
                np.add.at(total, first[n] + win.value.probes(ids, n, k)[1], 1)
        hit = np.flatnonzero(total)
        return {"key": hit, "n": total[hit]}

    freq = np.zeros(sum(map(len, keys.values())), np.int64)
    if len(freq):  # as many rows as the block has shingles, at most
        for r in arrow_map(src.select("text"), count, "key long, n long", rows=0).groupBy("key").agg(F.sum("n").alias("n")).collect():
            freq[r["key"]] = r["n"]
    key = np.zeros(len(w.place), np.int64)
    for n in w.sizes:
        own = w.place[:, 0] == n
        key[own] = first[n] + np.searchsorted(keys[n], w.place[own, 1])
    order = np.lexsort((w.place[:, 3], freq[key], w.place[:, 2]))
    prefix = order[np.unique(w.place[order, 2], return_index=True)[1]]  # rarest, then leftmost, of each window
    out = {}
    for n in w.sizes:
        p = w.place[prefix[w.place[prefix, 0] == n]]
        p = p[np.argsort(p[:, 1], kind="stable")]
        codes, at = np.unique(p[:, 1], return_index=True)
        out[n] = (codes, np.append(at, len(p)), p[:, 2], p[:, 3])
    return out


def _probe(state: DataFrame, win, prefix: dict[int, tuple]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        w = win.value
        out = {c: batch.column(c).to_pylist() for c in ("starts", "ends", "items")} | {"n_words": []}
        for row, t in enumerate(binary_texts(batch.column("text"))):
            ids = w.ids(words_of(t))
            out["n_words"].append(len(ids))
            for n, (codes, cut, wins, offs) in prefix.items():
                at, i = w.probes(ids, n, codes)
                if not len(at):
                    continue
                many = cut[i + 1] - cut[i]
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[i], many)
                c, start = wins[k], np.repeat(at, many) - offs[k]
                fits = (start >= 0) & (start + w.length[c] <= len(ids))  # positional and length bounds
                c, start = c[fits], start[fits]
                same = np.ones(len(c), bool)
                for j in range(w.size):
                    inside = w.length[c] > j
                    same &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == w.words[c, j])
                c, start = c[same], start[same]
                if len(c):
                    out["starts"][row] = out["starts"][row] + start.tolist()
                    out["ends"][row] = out["ends"][row] + (start + w.length[c]).tolist()
                    out["items"][row] = sorted({*out["items"][row], *(x for i in np.unique(c) for x in w.items[i])})
        return {c: batch.column(c) for c in ("doc_id", "row", "text")} | out

    return arrow_map(state, run, "doc_id long, text string, row long, starts array<long>, ends array<long>, "
                                 "items array<string>, n_words long")


def _summary(state: DataFrame, ratio: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        n_hit, digest, n_items = [], [], []
        for n, s, e, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends", "items"))):
            step = np.bincount(s, minlength=n + 1) - np.bincount(e, minlength=n + 1) if s else np.zeros(1)
            n_hit.append(int((np.cumsum(step) > 0).sum()))
            n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n_words": batch.column("n_words"), "n_hit": n_hit, "n_items": n_items, "items_sha256": digest}

    out = arrow_map(state, run, "doc_id long, row long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))
