"""Survival of stays (T6-T8): Kaplan-Meier curves and the log-rank test.

Rows are first reduced to one row per (cohort, distinct time) with event / censor counts. The
running sums over times are taken in two phases: within (cohort, whole day), then over the days'
totals, of which there are at most as many as the study has days; so a cohort with many distinct
times is spread over many tasks. Nothing is rounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import erfc, seconds_between
from cohortspark.params import SECONDS_PER_DAY, StudyParams


def km_input(stays: DataFrame, params: StudyParams = StudyParams(), event: str = "exists_end_of_stay") -> DataFrame:
    """Duration in days to the stay end (open stays end at km_limit_date), event flag,
    cohort = pre / post cutoff."""
    end = F.coalesce(F.col("visit_end_date"), F.lit(params.km_limit_date).cast("timestamp_ntz"))
    ev = F.col("visit_end_date").isNotNull() if event == "exists_end_of_stay" else F.coalesce(F.col(event), F.lit(False))
    return stays.select(
        "encounter_num",
        F.when(F.col("date") < F.lit(params.cutoff).cast("date"), F.lit("pre")).otherwise(F.lit("post")).alias("cohort"),
        (seconds_between(F.col("visit_start_date"), end) / F.lit(float(SECONDS_PER_DAY))).alias("duration"),
        ev.alias("event"),
    )


def _per_time(km: DataFrame) -> DataFrame:
    return km.groupBy("cohort", "duration").agg(
        F.count_if("event").alias("n_event"), F.count_if(~F.col("event")).alias("n_censored")
    ).withColumn("_day", F.floor("duration"))


def _running(t: DataFrame, keys: list[str], sums: dict[str, str], later: bool) -> DataFrame:
    """For each row the sum of ``sums`` (new column -> column) over its own and all earlier (or
    later) durations, within ``keys``."""
    order = F.desc("duration") if later else F.asc("duration")
    inside = Window.partitionBy(*keys, "_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    days = Window.partitionBy(*keys).orderBy(F.desc("_day") if later else F.asc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy(*keys, "_day").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    carried = totals.select(*keys, "_day", *[
        F.coalesce(F.sum(f"_t{i}").over(days), F.lit(0)).alias(f"_c{i}") for i in range(len(sums))])
    out = t.join(carried, [*keys, "_day"])
    for i, (new, c) in enumerate(sums.items()):
        out = out.withColumn(new, F.sum(c).over(inside) + F.col(f"_c{i}"))
    return out.drop(*[f"_c{i}" for i in range(len(sums))])


def km_curve(km: DataFrame) -> DataFrame:
    """Per cohort and distinct time: at risk (suffix sum), events, censored, survival
    S(t) = prod(1 - d/n) as exp(sum log), 0 from the first time where d = n."""
    t = _per_time(km).withColumn("_n", F.col("n_event") + F.col("n_censored"))
    t = _running(t, ["cohort"], {"n_at_risk": "_n"}, later=True)
    gone = F.col("n_event") >= F.col("n_at_risk")
    t = t.withColumn("_gone", gone.cast("int")).withColumn(
        "_log", F.when(gone, F.lit(0.0)).otherwise(F.log1p(-F.col("n_event") / F.col("n_at_risk"))))
    t = _running(t, ["cohort"], {"_sum": "_log", "_zeros": "_gone"}, later=False)
    s = F.when(F.col("_zeros") > 0, F.lit(0.0)).otherwise(F.exp("_sum"))
    return t.select("cohort", "duration", "n_event", "n_censored", "n_at_risk", s.alias("survival"))


def at_risk_days(km: DataFrame, days: int = 30) -> DataFrame:
    """T7 table under the curve: stays still at risk at the start of days 0..days. A stay with a
    negative duration is never at risk."""
    grid = km.select("cohort").distinct().select("cohort", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day"))
    last = F.least(F.floor("duration").cast("int"), F.lit(days))
    n = km.where("duration >= 0").groupBy("cohort", last.alias("_last")).agg(F.count(F.lit(1)).alias("n"))
    cover = n.select("cohort", "n", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("day"))
    beyond = cover.groupBy("cohort", "day").agg(F.sum("n").alias("n_at_risk"))
    return grid.join(beyond, ["cohort", "day"], "left").fillna(0, subset=["n_at_risk"])


def logrank(km: DataFrame, first: str = "pre", second: str = "post") -> DataFrame:
    """Log-rank chi-square (1 df) of two cohorts and p = erfc(sqrt(chi2 / 2)). One row per
    distinct time holds both cohorts' events and exits."""
    t = _per_time(km).withColumn("_n", F.col("n_event") + F.col("n_censored"))
    p = t.groupBy("duration", "_day").pivot("cohort", [first, second]).agg(F.sum("n_event").alias("d"), F.sum("_n").alias("k"))
    p = p.fillna(0)
    p = _running(p, [], {"n1": f"{first}_k", "n2": f"{second}_k"}, later=True)
    d1, d2 = F.col(f"{first}_d"), F.col(f"{second}_d")
    # in doubles: the product of four counts leaves the range of a long from some ten thousand stays on
    n1, n2, d = (c.cast("double") for c in (F.col("n1"), F.col("n2"), d1 + d2))
    n = n1 + n2
    e1 = d * n1 / n
    v = F.when(n > 1, d * n1 * n2 * (n - d) / (n * n * (n - 1))).otherwise(F.lit(0.0))
    agg = p.where(d > 0).agg(F.sum(d1).alias("observed_1"), F.sum(e1).alias("expected_1"), F.sum(v).alias("variance"))
    chi2 = (F.col("observed_1") - F.col("expected_1")) ** 2 / F.col("variance")
    return agg.select("observed_1", "expected_1", chi2.alias("chi2"), erfc(F.sqrt(chi2 / 2.0)).alias("p_value"))
