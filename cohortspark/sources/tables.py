"""Scans, sinks and debug samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; a column list becomes the scan's ReadSchema."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Stage hand-over as Parquet, overwrite."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file with a header. The rows are gathered by a shuffle, so
    that the stages before it keep their tasks."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def debug_sample(df: DataFrame, n: int, key: str, seed: int = 7919) -> DataFrame:
    """Deterministic 'random' sample of n rows: the first n in the order of a seeded hash of the
    key. The limit is the feature here; it plans as a per-partition top-n, then a merge."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)).limit(n)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "encounter_num", path: str | None = None) -> None:
    """S4 for production stage tables: bucketed and sorted by the stay key, so later joins and
    aggregates on that key (notes x stays, mentions -> stays) read co-located buckets and
    skip the shuffle. ``path`` places the table in a shared location (e.g. next to
    ``spark.checkpoint.dir``) instead of the session warehouse."""
    w = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
