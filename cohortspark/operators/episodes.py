"""Chain a patient's positive stays into episodes (gaps and islands, no graph, no self-join).

Stays i and j are linked when start_i <= start_j and start_j - end_i <= delta (overlap counts;
an open stay, end null, never links forward). Linked stays form an episode; its first stay
(by start, then end desc nulls last, then id) is not recurrent, every other stay is.

Per patient in sort order a stay opens a new episode iff the running max of the earlier
stays' ends is null or start - max_end > delta. This equals the connected components of the
pair rule because an edge i -> k with start_k >= start_j implies the edge i -> j.

Scale: the running max is split in two phases so that a patient holding a large share of all
stays is spread over many tasks. Phase 1 runs the window per (patient, time bucket);
phase 2 carries the max end of all earlier buckets of the patient (one small row per
bucket) back into each bucket. max is associative, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import seconds_between
from cohortspark.params import StudyParams


def tag_episodes(
    stays: DataFrame,
    params: StudyParams = StudyParams(),
    positive_col: str = "positive_visit",
    start: str = "visit_start_date",
    end: str = "visit_end_date",
    patient: str = "patient_num",
    stay_id: str = "encounter_num",
) -> DataFrame:
    """Adds ``recurrent_visit``; stays that are not positive, or lack start or patient, get False.

    One hash partitioning on (patient key, salt, bucket) serves the local window, the bucket
    summary and the join back of the carried max; rows that cannot chain (not positive, no
    start, no patient) get a null patient key and a salt, so they never match and never pile
    up in one null-key partition."""
    usable = F.coalesce(F.col(positive_col) & F.col(start).isNotNull() & F.col(patient).isNotNull(), F.lit(False))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bucket = F.floor(F.timestamp_diff("SECOND", epoch, F.col(start)) / F.lit(params.episode_bucket_seconds))
    x = (
        stays.withColumn("_u", usable)
        .withColumn("_pk", F.when(F.col("_u"), F.col(patient)))
        .withColumn("_salt", F.when(F.col("_u"), F.lit(0)).otherwise(1 + F.abs(F.xxhash64(F.col(stay_id)) % 4096)))
        .withColumn("_bucket", F.when(F.col("_u"), bucket).otherwise(F.lit(0)))
    )
    keys = ["_pk", "_salt", "_bucket"]
    order = [F.col(start).asc(), F.col(end).desc_nulls_last(), F.col(stay_id).asc()]
    w_local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_local_prev", F.max(end).over(w_local)).withColumn(
        "_bucket_max", F.max(end).over(Window.partitionBy(*keys)))

    # one summary row per (patient, bucket), from a second, narrow read of the stays
    w_carry = Window.partitionBy("_pk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        x.groupBy(*keys)
        .agg(F.max("_bucket_max").alias("_bucket_max"))
        .withColumn("_carry", F.max("_bucket_max").over(w_carry))
        .select(*keys, "_carry")
    )
    prev_end = F.greatest(F.col("_local_prev"), F.col("_carry"))
    new_episode = prev_end.isNull() | (seconds_between(prev_end, F.col(start)) > F.lit(params.delta_min_visits))
    return (
        x.join(carry, keys, "left")
        .withColumn("recurrent_visit", F.col("_u") & ~new_episode)
        .drop("_u", "_pk", "_salt", "_bucket", "_local_prev", "_bucket_max", "_carry")
    )


def tag_positive(stays: DataFrame, positive: DataFrame, params: StudyParams = StudyParams(), stay_id: str = "encounter_num",
                 **columns) -> DataFrame:
    """``stays`` with ``positive_visit``, the boolean columns of ``positive`` (one row per positive stay, by
    ``stay_id``) and ``recurrent_visit``, all False for the other stays. Only the positive stays go through the
    windows of ``tag_episodes``; all stays take part in one join by stay."""
    flags = [c for c in positive.columns if c != stay_id]
    tagged = tag_episodes(stays.join(positive, stay_id).withColumn("positive_visit", F.lit(True)), params, stay_id=stay_id, **columns)
    names = ["positive_visit", *flags, "recurrent_visit"]
    return stays.join(tagged.select(stay_id, *names), stay_id, "left").fillna(False, subset=names)
