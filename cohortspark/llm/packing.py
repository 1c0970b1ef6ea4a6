"""Best-fit packing by a plan over the length histogram.

Every document's ids (end id included) are cut into pieces of at most ``capacity`` ids; only
longer documents are cut, and their first piece may be shorter. The plan is made from the counts
per length, not from documents: lengths go in descending order, each run of equal pieces goes
into the fullest open sequences that can take it, whole groups of equally full sequences at a
time. The plan has at most a few rows per (length, fill) pair: a group is split at most twice per
length and its room at least halves each time it is used, so 4 * capacity groups are used at most
log2(capacity) times each, whatever the number of documents. Pieces are ranked within their
length (numbers per salted part, then a running sum of the parts' counts) and take the slot that
the plan has for (length, rank).

Defined results: null or empty text is the end id alone; a null doc_id keeps its pieces; repeated
rows are packed each; equal (doc_id, start, length, crc) rows are interchangeable; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, stage
from cohortspark.llm.tokens import encoder, read_model

#: pieces per salted part of one length, and parts at least
PART_ROWS, MIN_PARTS = 100_000, 64


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts. Rows (length, rank_from, rank_to, sequence_from,
    per_sequence, offset): piece number rank_from + i of that length goes to sequence
    sequence_from + i // per_sequence at offset + (i % per_sequence) * length."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that open groups have
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    next_seq = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, next_seq
                n = -(-left // (capacity // length))
                next_seq += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if left and full < n:  # one sequence takes the rest
                rows.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, n - full)
    return rows


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_model(tokenizer_path))
    end = int(end_id).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        enc, ids = encoder(*shipped.value), batch.column("doc_id").to_pylist()
        for i in range(0, len(ids), 64):
            for doc, x in zip(ids[i:i + 64], enc.ids(batch.column("text")[i:i + 64].to_pylist())):
                x += end
                for k, (s, n) in enumerate(piece_bounds(len(x) // 4, capacity)):
                    for c, v in zip(out, (doc, k, s, n, zlib.crc32(x[4 * s:4 * (s + n)]))):
                        out[c].append(v)
        return out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(src, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to staged ``pieces``."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = np.array(plan_slots(histogram, capacity), np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    plan = spark.sparkContext.broadcast(slots)

    parts = max(MIN_PARTS, sum(histogram.values()) // PART_ROWS)
    x = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = x.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = x.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).cast("long").alias("rank"))

    def place(batch: pa.RecordBatch) -> dict:
        s, length, rank = plan.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        lengths, first = np.unique(s[:, 0], return_index=True)
        row = np.empty(len(rank), np.int64)
        for at in np.unique(length):  # join on rank within length
            i = np.searchsorted(lengths, at)
            own = slice(first[i], first[i + 1] if i + 1 < len(first) else len(s))
            hit = length == at
            row[hit] = first[i] + np.searchsorted(s[own, 1], rank[hit], side="right") - 1
        i = rank - s[row, 1]
        out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return out | {"sequence_id": s[row, 3] + i // s[row, 4], "offset": s[row, 5] + i % s[row, 4] * length}

    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                     text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, end_id, text_col, id_col), "pieces"), capacity)
