"""Annotation samples (K1, K2, K4).

Random draws are replaced by a seeded hash of the id (md5 of "seed-id"), so a sample is
uniform, reproducible and the same in any engine, whatever the size of the ids.

Top-n per stratum is exact and skew-safe in two phases: each (stratum, salt) sub-group keeps
its own first n rows, then the at most salts * n survivors of a stratum are ranked again. A
stratum holding a large share of all rows is therefore sorted by many tasks, not one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_key(id_col: str = "note_id", seed: int = 7919):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def _order(df: DataFrame, id_col: str) -> DataFrame:
    """Adds ``_i`` (0-based place in key order) and ``_n`` (rows): places are counted within the
    key's first two hex digits, and the 256 parts' counts are summed."""
    x = df.withColumn("_k", order_key(id_col)).withColumn("_part", F.substring("_k", 1, 2))
    parts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy().orderBy("_part")  # at most 256 rows
    parts = parts.select("_part", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    own = Window.partitionBy("_part").orderBy("_k", id_col)
    return x.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(parts), "_part").withColumn(
        "_i", F.col("_own") + F.col("_before")).drop("_k", "_part", "_own", "_before")


def stratified_sample(df: DataFrame, strata: list[str], n_per_stratum: int, id_col: str = "note_id",
                      avoid: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """K1: n rows per stratum without replacement, avoiding ids listed in ``avoid``."""
    if avoid is not None:
        df = df.join(avoid.select(id_col), id_col, "left_anti")
    df = df.withColumn("_k", order_key(id_col)).withColumn("_salt", F.xxhash64(F.col(id_col)) % salts)
    w1 = Window.partitionBy(*strata, "_salt").orderBy("_k", id_col)
    first = df.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n_per_stratum)
    w2 = Window.partitionBy(*strata).orderBy("_k", id_col)
    out = first.withColumn("sample_rank", F.row_number().over(w2)).where(F.col("sample_rank") <= n_per_stratum)
    return out.drop("_k", "_salt", "_r")


def allocate(sample: DataFrame, annotators: list[str], share: float, id_col: str = "note_id") -> DataFrame:
    """K2: in order-key order, the first int(n * share) sample rows go to every annotator, the
    rest round-robin."""
    s = _order(sample, id_col)
    s = s.withColumn("_ns", F.floor(F.col("_n") * F.lit(share)))
    n_shared = F.col("_ns")
    s = s.withColumn("shared", F.col("_i") < n_shared)
    arr = F.array(*[F.lit(a) for a in annotators])
    who = F.when(F.col("shared"), arr).otherwise(
        F.array(F.element_at(arr, ((F.col("_i") - n_shared) % len(annotators) + 1).cast("int"))))
    return s.withColumn("annotator", F.explode(who)).drop("_i", "_n", "_ns")


def annotation_tasks(mentions: DataFrame, per_rf: bool = False, rf_col: str = "rf_name") -> DataFrame:
    """K4: task rows: integer offsets, label name, title, dedup id (note or note-RF)."""
    dedup = F.concat_ws("-", F.col("note_id").cast("string"), F.col(rf_col)) if per_rf else F.col("note_id").cast("string")
    return mentions.select(
        F.col("note_id"), F.col("start_char").cast("int").alias("start"), F.col("end_char").cast("int").alias("end"),
        F.col("std_lexical_variant").alias("label_name"),
        F.concat(F.lit("note "), F.col("note_id").cast("string")).alias("title"),
        dedup.alias("note_id_dedup"),
    )


def allocate_pairs(sample: DataFrame, annotators: list[str], share: float, id_col: str = "note_id") -> DataFrame:
    """K3: shared rows go to two annotators, the rest to one; choices come from the
    hash's later digits (a deterministic stand-in for a random draw)."""
    k = len(annotators)
    s = _order(sample, id_col)
    s = s.withColumn("shared", F.col("_i") < F.floor(F.col("_n") * F.lit(share)))
    arr = F.array(*[F.lit(a) for a in annotators])
    digits = lambda at: F.conv(F.substring(order_key(id_col), at, 8), 16, 10).cast("long")
    first = (digits(9) % k).cast("int")
    second = ((first + 1 + digits(17) % max(k - 1, 1)) % k).cast("int")
    who = F.when(F.col("shared") & F.lit(k > 1), F.array(F.element_at(arr, first + 1), F.element_at(arr, second + 1))) \
        .otherwise(F.array(F.element_at(arr, first + 1)))
    return s.withColumn("annotator", F.explode(who)).drop("_i", "_n")
