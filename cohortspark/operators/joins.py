"""Joins with a cardinality check inside the plan; joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unique(df: DataFrame, on: list[str], side: str, validate: str) -> DataFrame:
    """``df``, failing when it is run if a key occurs twice. The count is a window over the join keys,
    so it uses the partitioning that the join needs anyway."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    text = F.lit(f"{side} keys {', '.join(on)} are not unique ({validate})")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:m",
                 check: bool = True) -> DataFrame:
    """Join and verify the key cardinality ('1:1', '1:m', 'm:1', 'm:m'): a side that must be unique and
    is not stops the query with a message that names the side and the keys."""
    if validate not in {"1:1", "1:m", "m:1", "m:m"}:
        raise ValueError(f"validate must be 1:1, 1:m, m:1 or m:m, not {validate!r}")
    if check and validate[0] == "1":
        left = _unique(left, on, "left", validate)
    if check and validate[2] == "1":
        right = _unique(right, on, "right", validate)
    return left.join(right, on, how)


#: a key with more than one row in so many is hot; there are at most this many hot keys
HOT_SHARE = 200
#: tasks that a hot key's rows are dealt to
SALTS = 64


def hot_keys(counts: DataFrame, on: list[str], n: str, share: int = HOT_SHARE) -> DataFrame:
    """The keys of ``counts`` (one row per key, ``n`` rows each) that hold more than one row in ``share``: at
    most ``share`` keys, so that they may be broadcast at any size."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(n) * share > F.col("_total")).select(*on)


def hot_join(many: DataFrame, small: DataFrame, on: list[str], salt_by: str, how: str = "inner", hot: DataFrame | None = None,
             salts: int = SALTS) -> DataFrame:
    """Join ``many`` with ``small`` (one row per key). The rows of a hot key are dealt over ``salts`` tasks by a
    hash of ``salt_by``, and the key's row in ``small`` is repeated that often; all other keys join as they
    are. ``how``: inner or left."""
    if hot is None:
        hot = hot_keys(many.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, "_n")
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    is_hot = F.coalesce("_hot", F.lit(False))
    a = many.join(hot, on, "left").withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(salt_by), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    b = small.join(hot, on, "left").withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.drop("_hot").join(b.drop("_hot"), [*on, "_salt"], how).drop("_salt")
