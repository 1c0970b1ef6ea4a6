"""Helpers shared by the training-data operators: scratch tables, Arrow maps, bucket tiles
and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import checkpoint_dir

#: tables of more rows than this are never broadcast
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage is
    cut there, so that a lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the folder of a table of ``stage`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, shuffle files go as soon as the query that wrote them ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1024) -> DataFrame:
    """``fn`` maps at most ``rows`` rows of an Arrow batch (0: the whole batch) to a dict of output
    columns (arrays or lists); small parts bound the Python objects alive at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    out = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = rows or max(1, whole.num_rows)
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                cols = fn(b)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type)
                     for c, f in ((cols[f.name], f) for f in out)], schema=out)

    return df.mapInArrow(run, schema)


class Shared:
    """A broadcast object of this subpackage. Broadcasts are pickled with their classes by reference, which
    workers without an installed copy cannot follow, so the object travels as bytes that hold its classes."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.known: list = []

    def __getstate__(self):
        return self.sent

    def __setstate__(self, sent):
        self.sent, self.known = sent, []

    @property
    def value(self):
        if not self.known:
            self.known.append(cloudpickle.loads(self.sent.value))
        return self.known[0]


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """What tells the rows of one doc_id apart: a hash of id and text (equal rows share it)."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def binary_texts(col: pa.Array) -> list:
    """UTF-8 bytes of a string column; null stays None."""
    return col.cast(pa.binary()).to_pylist()


def crc_fold(doc_id, parts: int):
    """crc32 of doc_id as text, modulo ``parts`` (null for a null doc_id)."""
    return F.crc32(doc_id.cast("string")) % parts


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint for a staged table that is counted to be small; else the plain table,
    which Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# ------------------------------------------------------------------ pairs within buckets

def tiles(rows: DataFrame, counts: DataFrame, id_col: str, tile_rows: int) -> DataFrame:
    """Split the buckets of ``rows`` (column ``bucket``) into tiles of bounded size.

    ``counts`` (bucket, n) holds the buckets of more than ``tile_rows`` rows. Such a bucket is
    dealt into c = ceil(n / tile_rows) chunks by a hash of ``id_col``; a row goes to the tiles
    (own chunk, j) for every j, so each pair of rows meets in exactly one tile and no task
    holds more than two chunks. Returns rows with ``ta``, ``tb`` and ``chunk``, partitioned and
    sorted by (bucket, ta, tb)."""
    hot = stage(counts.select("bucket", F.ceil(F.col("n") / tile_rows).cast("int").alias("_c")), "hot")
    x = rows.join(bounded_broadcast(hot), "bucket", "left")
    c = F.coalesce("_c", F.lit(1))
    x = x.withColumn("chunk", F.pmod(F.xxhash64(id_col, F.lit(7)), c).cast("int"))
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), c - 1)))
    x = x.withColumn("ta", F.least("chunk", "_j")).withColumn("tb", F.greatest("chunk", "_j")).drop("_c", "_j")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, "bucket", "ta", "tb").sortWithinPartitions("bucket", "ta", "tb")


def map_runs(df: DataFrame, fn: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each run of equal (bucket, ta, tb) in a frame made by ``tiles``. Runs of
    one row are skipped; a run that spans Arrow batches is put together first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def bounds(t: pa.Table) -> np.ndarray:
        cut = np.zeros(t.num_rows, bool)
        cut[0] = True
        for k in ("bucket", "ta", "tb"):
            v = t.column(k).to_numpy()
            cut[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(cut), t.num_rows)

    def emit(parts: list[dict]) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate([p[f.name] for p in parts]), type=f.type) for f in out]
        return pa.RecordBatch.from_arrays(cols, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            same = held and all(
                held[-1].column(k)[-1].as_py() == new.column(k)[-1].as_py() for k in ("bucket", "ta", "tb"))
            if same and all(new.column(k)[0].as_py() == new.column(k)[-1].as_py() for k in ("bucket", "ta", "tb")):
                held.append(new)  # still inside one run
                continue
            t = pa.concat_tables([*held, new]).combine_chunks()
            cut = bounds(t)
            parts = [p for i, j in zip(cut[:-2], cut[1:-1]) if j - i > 1 and (p := fn(t.slice(i, j - i))) is not None]
            if parts:
                yield emit(parts)
            held = [t.slice(cut[-2])]
        if held:
            t = pa.concat_tables(held).combine_chunks()
            cut = bounds(t)
            parts = [p for i, j in zip(cut[:-1], cut[1:]) if j - i > 1 and (p := fn(t.slice(i, j - i))) is not None]
            if parts:
                yield emit(parts)

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ------------------------------------------------------------------ connected components

def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (id, component), component the
    smallest id reachable; only ids that have a link to another id occur.

    Alternating large-star and small-star rounds; each round is a staged table. A hub's edges
    are joined with one row (its minimum). The minima are staged too: Spark splits a skewed join
    of two tables, but not one whose other side is an aggregate in the same plan."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        low2 = stage(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stage(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _mark(nxt)
        e, done, mark = nxt, new == mark, new
        if done:
            break
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(r)
