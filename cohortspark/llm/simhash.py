"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints, verified Hamming links.

Fingerprint: lower-case A-Z, split at ASCII white space, hash each k-word shingle (repeats
count) with XXH64, and set a bit where more than half of the hashes have it. Equal
fingerprints are one node. Two fingerprints that differ in at most ``max_bits`` bits agree in
one of ``max_bits + 1`` blocks, so all links are found among fingerprints that share a block;
large blocks are dealt into tiles, and each tile keeps a spanning forest of its links only.

Defined results: null text counts as text without words (fingerprint zero, which links like
any other); a null doc_id links with nothing and gets a null component; repeated rows of one
doc_id share its component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, binary_texts, components, forest, map_runs, stage, tiles

TILE_ROWS = 4096


def fingerprint(text: bytes | None, k: int, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # whole text, bounded memory
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long, one row per document."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = [fingerprint(t, k) for t in binary_texts(batch.column(1))]
        return {"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(src, run, "doc_id long, fp long")


def hamming_links(fps: DataFrame, max_bits: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that connect all rows (id, fp) whose fingerprints differ in at most
    ``max_bits`` bits: a spanning forest of each tile's links, never all pairs. ``fps`` holds
    distinct fingerprints."""
    blocks = max_bits + 1
    edge = [64 * i // blocks for i in range(blocks + 1)]
    keys = [F.xxhash64(F.lit(i), F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND((1 << (hi - lo)) - 1))
            for i, (lo, hi) in enumerate(zip(edge, edge[1:]))]
    rows = fps.select("id", "fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))

    def verify(run: pa.Table) -> dict | None:
        ids, fp = run.column("id").to_numpy(), run.column("fp").to_numpy().view(np.uint64)
        chunk, cross = run.column("chunk").to_numpy(), run.column("ta")[0].as_py() != run.column("tb")[0].as_py()
        left = np.flatnonzero(chunk == run.column("ta")[0].as_py()) if cross else np.arange(len(ids))
        right = np.flatnonzero(chunk == run.column("tb")[0].as_py()) if cross else left
        found_a, found_b = [], []
        for i in range(0, len(left), 256):
            near = np.bitwise_count(fp[left[i:i + 256], None] ^ fp[right][None, :]) <= max_bits
            x, y = np.nonzero(near)
            found_a.append(left[i:i + 256][x])
            found_b.append(right[y])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        root = forest(a, b, len(ids))
        child = np.flatnonzero(root != np.arange(len(ids)))
        return {"a": ids[child], "b": ids[root[child]]} if len(child) else None

    dealt = tiles(rows, sizes.where(F.col("n") > tile_rows), "id", tile_rows)
    return map_runs(dealt, verify, "a long, b long").distinct()


def simhash_classes(docs: DataFrame, k: int = 3, max_bits: int = 3, text_col: str = "text",
                    id_col: str = "doc_id", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable over links of at most ``max_bits`` differing bits, itself included)."""
    fps = stage(fingerprints(docs, k, text_col, id_col), "fps")
    nodes = stage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    # documents that repeat a doc_id with another text tie their fingerprints together
    same = fps.where("doc_id is not null").distinct().join(nodes, "fp").where("id <> doc_id").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    repeated = same.join(nodes.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    comp = components(hamming_links(nodes, max_bits, tile_rows).unionByName(repeated))
    of_fp = nodes.join(comp, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = fps.join(of_fp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out
