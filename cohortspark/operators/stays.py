"""Stay-level operators: enrichment (F3-F6), mention roll-up (A1, A2), flags (P12-P15, J5),
score join (J12), per-RF long form (U2, A13), method comparison (J6, J9), weights (J10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import (
    age_band,
    age_years,
    death_flag,
    history_flag,
    mention_flag,
    month_start,
    seconds_between,
)
from cohortspark.operators.joins import hot_join
from cohortspark.params import StudyParams


def enrich_stays(visits: DataFrame, patients: DataFrame, params: StudyParams = StudyParams()) -> DataFrame:
    """J2 + F3/F4/F6 + P14: patient columns, age, band, month, year, duration, death flag.

    The patient table grows with the data, so no broadcast hint: AQE switches to a broadcast
    hash join at run time only when the measured side is under the threshold.
    """
    s = visits.join(patients, "patient_num", "left")
    return (
        s.withColumn("age", age_years("birth_date", "visit_start_date"))
        .withColumn("age_cat", age_band("age", params))
        .withColumn("sex_cd", F.coalesce(F.col("sex_cd"), F.lit("Unknown")))
        .withColumn("date", month_start("visit_start_date"))
        .withColumn("year", F.year("date"))
        .withColumn("duration_seconds", seconds_between("visit_start_date", "visit_end_date").cast("double"))
        .withColumn("death", death_flag("discharge_mode", params))
    )


def flag_mentions(mentions: DataFrame, method: str = "full") -> DataFrame:
    """P12/P13 on a mention table with the five qualifier columns."""
    return mentions.withColumn("instance_flag", mention_flag(method)).withColumn("history_flag", history_flag())


def stay_rollup(mentions: DataFrame, params: StudyParams = StudyParams()) -> DataFrame:
    """A1 + A2 + P15: flagged mentions to one row per stay.

    Stay attributes (patient, dates, modes) are joined afterwards, 1:1 on the stay, instead of
    being carried through the aggregate. Count and boolean aggregates combine map-side; the
    term arrays are bounded by the stay's mentions."""
    aggs = [
        F.sort_array(F.collect_set("note_id")).alias("note_ids"),
        F.sort_array(F.collect_set("std_lexical_variant")).alias("std_lexical_variants"),
        F.count(F.lit(1)).alias("n_mentions"),
        F.bool_or("instance_flag").alias("has_instance"),
        F.bool_or("history_flag").alias("has_history"),
        F.count_if("instance_flag").alias("n_positive_mentions"),
        F.sort_array(F.collect_list(F.when(F.col("instance_flag"), F.col("std_lexical_variant")))).alias(
            "std_positive_lexical_variants"
        ),
    ]
    out = mentions.where(F.col("encounter_num").isNotNull()).groupBy("encounter_num").agg(*aggs)
    return out.withColumn(
        "std_positive_lexical_variants",
        F.when(F.size("std_positive_lexical_variants") > 0, F.col("std_positive_lexical_variants")),
    ).withColumn("nlp_positive", F.col("n_positive_mentions") >= F.lit(params.threshold_positive))


def stay_table(rollup: DataFrame, notes: DataFrame, stays: DataFrame, carried: list[str]) -> DataFrame:
    """A1 in full: the roll-up with the stay's ``carried`` columns, the distinct categories of its notes
    (the third array) and its number of notes. ``notes`` are the notes that the mentions come from, with
    ``n_docs_per_visit``; they are reduced to a row per stay without their text before the join."""
    per = notes.where(F.col("encounter_num").isNotNull()).groupBy("encounter_num").agg(
        F.sort_array(F.collect_set("note_category")).alias("concept_cds"), F.max("n_docs_per_visit").alias("n_docs_per_visit"))
    return rollup.join(per, "encounter_num", "left").join(stays.select("encounter_num", *carried), "encounter_num", "left")


def rf_flags(stays: DataFrame, rf_mentions: DataFrame, rf_names: list[str]) -> DataFrame:
    """One boolean column per risk factor, true when the stay has >= 1 kept mention of it.

    One pass: pivot on the known RF names (no per-RF re-read), then left join + coalesce.
    """
    piv = (
        rf_mentions.groupBy("encounter_num")
        .pivot("rf_name", rf_names)
        .agg(F.lit(True).alias("x"))
    )
    out = stays.join(piv, "encounter_num", "left")
    for rf in rf_names:
        out = out.withColumn(rf, F.coalesce(F.col(rf), F.lit(False)))
    return out


def rf_flags_from_mentions(mentions: DataFrame, rf_names: list[str], keep, rf_col: str = "rf_name") -> DataFrame:
    """J5 + P9 in one pass: per stay with any mention, one flag per risk factor, true when a
    mention of it passes the ``keep`` condition (e.g. not negated, not hypothetical)."""
    piv = mentions.groupBy("encounter_num").pivot(rf_col, rf_names).agg(F.bool_or(keep))
    for rf in rf_names:
        piv = piv.withColumn(rf, F.coalesce(F.col(rf), F.lit(False)))
    return piv


def rf_stays_long(stays: DataFrame, rf_names: list[str], id_col: str = "encounter_num") -> DataFrame:
    """Stay flags to (stay, rf_name, value) rows plus a composite id."""
    long = stays.unpivot([id_col], rf_names, "rf_name", "value")
    return long.withColumn("stay_rf_id", F.concat_ws("-", F.col(id_col).cast("string"), F.col("rf_name")))


def method_outer(a: DataFrame, b: DataFrame, key: str = "encounter_num") -> DataFrame:
    """Full outer join of two methods' stay flags (1:1 on the stay)."""
    return a.join(b, key, "full")


def rule_only(rule: DataFrame, ml: DataFrame, key: str = "encounter_num") -> DataFrame:
    """Positive under the rule method and not positive under the other (null = not positive)."""
    return rule.join(ml.where(F.coalesce(F.col("ml_positive"), F.lit(False))).select(key), key, "left_anti")


def add_weights(stays: DataFrame, weights: DataFrame) -> DataFrame:
    """Weight by (month, site); no match gives a null weight (ignored by sums). The stays of a hot
    month and site are dealt over many tasks."""
    return hot_join(stays, weights.select("date", "site_label", "stay_weight"), ["date", "site_label"], "encounter_num", "left")


def rf_mention_filter(mentions: DataFrame, subcategories: list[str] | None, drop_if_any: list[str],
                      sub_col: str = "std_lexical_variant") -> DataFrame:
    """Keep listed subcategories; drop a mention when any listed qualifier is true."""
    m = mentions if subcategories is None else mentions.where(F.col(sub_col).isin(*subcategories))
    if drop_if_any:
        from cohortspark.functions.columns import any_of

        m = m.where(~any_of(drop_if_any))
    return m
