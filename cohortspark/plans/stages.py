"""Stage tables for long study runs.

The text path (note selection -> mentions -> stay roll-up) is the expensive part of a study.
A run writes each stage as a Parquet table under the shared folder the cluster names in
``spark.checkpoint.dir`` and continues from the written table, so the lineage is cut: an
executor lost in a later analysis step re-reads a stage table instead of re-extracting
mentions from raw text. Nothing here uses executor-local storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortspark.session import checkpoint_dir


def stage_root(spark: SparkSession, run_id: str | None = None) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/stages/{run_id or uuid.uuid4().hex}"


def materialize(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a stage table and return a DataFrame reading it back."""
    path = f"{root}/{name}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def run_text_study(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """Text path with stage tables: selected notes, mentions, stays; then the monthly table
    and the per-sex ITS coefficients read from the stays stage."""
    from pyspark.sql import functions as F

    from cohortspark.operators import incidence, its, text
    from cohortspark.operators.episodes import tag_positive
    from cohortspark.operators.stays import flag_mentions, stay_rollup
    from cohortspark.plans import study
    from cohortspark.plans.study import P

    root = stage_root(spark, run_id)
    notes = materialize(study.selected_notes(spark, sf_dir), root, "selected_notes")
    ments = materialize(flag_mentions(study.linked_mentions(spark, sf_dir, notes)), root, "mentions")
    rolled = stay_rollup(ments, P).where("nlp_positive").select("encounter_num", "has_history")
    stays = materialize(tag_positive(study.stays(spark, sf_dir, P), rolled, P), root, "stays")
    outcome = incidence.outcome_stays(stays, P)
    monthly = incidence.monthly_table(outcome, ["sex_cd", "age_cat"], P, history_col="has_history")
    by_sex = outcome.groupBy("sex_cd", "date").agg(F.count(F.lit(1)).alias("n_sa"))
    coefs = its.coefficients(its.design(by_sex, ["sex_cd"], P), ["sex_cd"], P)
    return {"root": root, "mentions": ments, "stays": stays, "monthly": monthly, "its": coefs}
