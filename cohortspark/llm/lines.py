"""Line dedup: a segment-partition edit join over the lines of all documents.

Two lines within ``edits`` edits, the shorter cut into edits + 1 segments, keep one segment
unchanged at a place that the lengths bound. Each distinct line indexes its own segments under
its length and probes, for each length it may match, the few substrings that can be such a
segment. Lines that meet in a key are candidates; large keys are dealt into tiles; a candidate
pair is verified on what common prefix and suffix leave, by a banded bit-parallel edit distance,
unless its lines are in one class already. Classes are connected lines; the first line of a class
(by doc_id, then place) stays and the others are dropped.

Lines are compared without surrounding white space. Lines of fewer than ``min_chars`` characters
are never dropped and never compared. A document that loses lines until no compared line is left
goes as a whole if each line that remains is blank or equals a line of an earlier document; it stays,
with the lines that remain, if it is the first to hold one of them.

Equality rests on a 128-bit digest; its low half names a line among candidates only, and a line
whose full digest differs from that name's is left as it is.

Defined results: null or empty text has no lines to compare and stays as it is; rows with a null
doc_id stay as they are and are not compared; repeated rows (same doc_id and text) are one place
and stay alike; extra columns are kept by ``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, components, map_runs, stage, tiles

TILE_ROWS = 512
#: line names that a task remembers so as not to emit a frequent line again
SEEN_LINES = 250_000


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of ``length`` characters."""
    cut = [length * i // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def line_keys(line: str, edits: int) -> list[int]:
    """Hashes of (indexed length, segment number, substring): the line's own segments, and the
    substrings that may equal a segment of a line of its length or up to ``edits`` shorter."""
    raw, n, digest = line.encode("utf-32-le", "surrogatepass"), len(line), xxhash.xxh64_intdigest
    keys = {digest(raw[4 * s:4 * (s + k)], n * 64 + i) for i, (s, k) in enumerate(segments(n, edits))}
    for short in range(max(edits + 1, n - edits), n + 1):
        gap = n - short
        for i, (s, k) in enumerate(segments(short, edits)):
            low = max(s - i, s + gap - (edits - i), 0)
            high = min(s + i, s + gap + (edits - i), n - k)
            keys.update(digest(raw[4 * at:4 * (at + k)], short * 64 + i) for at in range(low, high + 1))
    return list(keys)


def within(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether two lines (code points) are at most ``edits`` edits apart. What the common prefix
    and suffix leave goes through an automaton whose bits are the 2 * edits + 1 diagonals of the
    band, one word per number of edits; it stops when no diagonal is alive."""
    if abs(len(a) - len(b)) > edits:
        return False
    m = min(len(a), len(b))
    diff = a[:m] != b[:m]
    start = int(diff.argmax()) if diff.any() else m
    a, b = a[start:], b[start:]
    m = min(len(a), len(b))
    diff = a[len(a) - m:][::-1] != b[len(b) - m:][::-1]
    end = int(diff.argmax()) if diff.any() else m
    s, t = a[:len(a) - end].tolist(), b[:len(b) - end].tolist()
    if not s or not t:
        return True
    if len(s) == 1 and len(t) == 1:
        return edits >= 1
    places: dict[int, int] = {}
    for j, c in enumerate(t):
        places[c] = places.get(c, 0) | 1 << j
    full = (1 << (2 * edits + 1)) - 1
    # bit d of alive[e]: prefixes of lengths i and i + d - edits are at most e edits apart
    alive = [(((1 << (e + 1)) - 1) << edits) & full for e in range(edits + 1)]
    for i, c in enumerate(s):
        match = places.get(c, 0)
        match = (match >> (i - edits) if i >= edits else match << (edits - i)) & full
        new, below = [], 0
        for e in range(edits + 1):
            x = alive[e] & match
            if e:
                before = alive[e - 1]
                x |= before | before >> 1 | below << 1
            below = x & full
            new.append(below)
        if not new[edits]:
            return False
        alive = new
    d = len(t) - len(s) + edits
    return bool(0 <= d <= 2 * edits and alive[edits] >> d & 1)


def _name(line: str) -> tuple[bytes, int]:
    digest = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def _places(src: DataFrame, min_chars: int) -> DataFrame:
    """Rows (doc_id, row, line_no, digest) of every line that is compared."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("doc_id", "row", "line_no", "digest")}
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
            for k, line in enumerate(text.split("\n")):
                if len(line := line.strip()) >= min_chars:
                    for c, v in zip(out, (doc, row, k, _name(line)[0])):
                        out[c].append(v)
        return out

    return arrow_map(src, run, "doc_id long, row long, line_no int, digest binary")


def _once(batches, min_chars: int, make):
    """Lists of ``make(name, line)`` for each compared line, a frequent line once per task."""
    seen: set[int] = set()
    for b in batches:
        out: list = []
        for text in (t for i in range(0, b.num_rows, 256) for t in b.column("text").slice(i, 256).to_pylist()):
            if len(out) >= 4000:
                yield out
                out = []
            for line in text.split("\n"):
                if len(line := line.strip()) >= min_chars and (name := _name(line))[1] not in seen:
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(name[1])
                    out.append(make(name, line))
        yield out


def _candidates(src: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Staged rows (bucket, id) of the keys in which at least two different lines meet."""

    def emit(batches):
        for out in _once(batches, min_chars, lambda name, line: (name[1], line_keys(line, edits))):
            for at in range(0, len(out), 20_000):
                part = out[at:at + 20_000]
                keys = np.fromiter((k for _, ks in part for k in ks), np.uint64).view(np.int64)
                ids = np.repeat(np.array([i for i, _ in part], np.int64), [len(ks) for _, ks in part])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["bucket", "id"])

    def shared(batches):
        last = None  # a key that spans batches is kept: more candidates, never fewer
        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column("bucket").to_numpy(), b.column("id").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            keep = ids[first] != ids[first + size - 1]
            keep[0] |= key[0] == last
            keep[-1] = True
            last = key[-1]
            keep = np.repeat(keep, size)
            keep[1:] &= (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], ["bucket", "id"])

    schema = "bucket long, id long"
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = src.select("text").mapInArrow(emit, schema).repartition(n, "bucket").sortWithinPartitions("bucket", "id")
    return stage(keys.mapInArrow(shared, schema), "line-keys")


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 20, tile_rows: int = TILE_ROWS, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """Membership of every compared line: doc_id, row (hash of the row), line_no, digest, class."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null and text is not null").select("*", F.xxhash64("doc_id", "text").alias("row"))
    lines = stage(_places(src, min_chars), "lines")
    met = _candidates(src, edits, min_chars)
    met = met.join(met.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high"),
                   "bucket").select("bucket", "id")
    met = stage(met, "line-candidates")

    def texts(batches):
        for out in _once(batches, min_chars, lambda name, line: (name[1], name[0], line)):
            for at in range(0, len(out), 5_000):
                part = out[at:at + 5_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in part], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))],
                    ["id", "digest", "line"])

    wanted = met.select("id").distinct()
    named = src.select("text").mapInArrow(texts, "id long, digest binary, line string").join(
        wanted.hint("shuffle_hash"), "id", "left_semi")
    named = stage(named.groupBy("id").agg(F.min(F.struct("digest", "line")).alias("x")).select("id", "x.*"), "line-texts")
    rows = met.join(named.select("id", "line"), "id")
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile_rows)

    def verify(run: pa.Table) -> dict | None:
        ids, chunk = run.column("id").to_numpy(), run.column("chunk").to_numpy()
        x = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in run.column("line").to_pylist()]
        ta, tb = run.column("ta")[0].as_py(), run.column("tb")[0].as_py()
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        left = [i for i in range(len(ids)) if chunk[i] == ta]
        right = left if ta == tb else [i for i in range(len(ids)) if chunk[i] == tb]
        by_size: dict[int, list[int]] = {}
        for i in right:
            by_size.setdefault(len(x[i]), []).append(i)
        for i in left:
            for size in range(len(x[i]) - edits, len(x[i]) + edits + 1):
                for j in by_size.get(size, ()):
                    if (i < j or ta != tb) and (a := top(i)) != (b := top(j)) and within(x[i], x[j], edits):
                        root[max(a, b)] = min(a, b)
        child = np.array([i for i in range(len(ids)) if top(i) != i], np.int64)
        return {"a": ids[child], "b": ids[[top(i) for i in child]]} if len(child) else None

    links = map_runs(tiles(rows, sizes, "id", tile_rows), verify, "a long, b long").distinct()
    near = components(links).join(named.select("id", "digest"), "id").select("digest", "component")
    return lines.join(near, "digest", "left").select(
        "doc_id", "row", "line_no", "digest",
        F.coalesce(F.unhex(F.lpad(F.hex("component"), 16, "0")), F.col("digest")).alias("class"))


def dropped_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, tile_rows: int = TILE_ROWS, text_col: str = "text",
                  id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, row, drop): the numbers of the lines that each document loses."""
    lines = stage(line_classes(docs, edits, min_chars, tile_rows, text_col, id_col), "line-classes")
    place = F.struct("doc_id", "row", "line_no")
    # staged, so that Spark can split the join at a class that holds many lines
    first = stage(lines.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first <> last").select("class", "first"), "line-firsts")
    gone = lines.join(first, "class").where(place != F.col("first"))
    return gone.select("doc_id", "row", "line_no").distinct().groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list("line_no")).alias("drop"))


def dedup_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, text_col: str = "text", id_col: str = "doc_id",
                drop_empty: bool = True, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus ``dropped`` (lines taken out).
    If ``drop_empty``, documents go that lose lines and are left without a line of ``min_chars``
    characters and without a shorter line that no earlier document has."""
    gone = dropped_lines(docs, edits, min_chars, text_col=text_col, id_col=id_col, **options).select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "drop")
    x = docs.withColumns({"_id": F.col(id_col).cast("long"), "_row": F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))})
    x = x.join(gone, ["_id", "_row"], "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("drop", i)), "\n")
    x = x.withColumn(text_col, F.when(F.col("drop").isNull(), F.col(text_col)).otherwise(kept))
    x = x.withColumn("dropped", F.coalesce(F.size("drop"), F.lit(0)))
    if drop_empty:
        bare = lambda line: F.btrim(line, F.lit(" \t\r\x0b\x0c"))
        short = docs.select(
            F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("_row"),
            F.explode(F.array_distinct(F.transform(F.split(F.col(text_col), "\n", -1), bare))).alias("line")).where(
            F.col("_id").isNotNull() & F.length("line").between(1, min_chars - 1))
        own = short.groupBy("line").agg(F.min(F.struct("_id", "_row")).alias("x")).select("x.*").distinct().withColumn("_own", F.lit(True))
        x = x.join(own, ["_id", "_row"], "left")
        x = x.where((F.col("dropped") == 0) | F.col("_own") | F.exists(
            F.split(F.col(text_col), "\n", -1), lambda line: F.length(bare(line)) >= min_chars)).drop("_own")
    return x.drop("_id", "_row", "drop")
