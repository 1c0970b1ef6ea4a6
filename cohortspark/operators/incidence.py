"""Monthly incidence tables and their relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.columns import safe_ratio
from cohortspark.params import SECONDS_PER_DAY, StudyParams


def in_window(params: StudyParams = StudyParams(), month: str = "date"):
    """P5: date_from <= month < date_upper_limit (test on the truncated month)."""
    m = F.col(month)
    return (m >= F.lit(params.date_from).cast("date")) & (m < F.lit(params.date_upper_limit).cast("date"))


def known_demographics(params: StudyParams = StudyParams()):
    """Sex known and age band known."""
    return (~F.col("sex_cd").isin(*params.unknown_sex)) & (F.col("age_cat") != F.lit("Unknown"))


def outcome_stays(
    stays: DataFrame,
    params: StudyParams = StudyParams(),
    keep_only_positive: bool = True,
    keep_only_not_recurrent: bool = True,
) -> DataFrame:
    """The stays an analysis counts."""
    s = stays
    if keep_only_positive:
        s = s.where(F.col("positive_visit"))
    s = s.where(known_demographics(params)).where(in_window(params))
    if keep_only_not_recurrent:
        s = s.where(~F.col("recurrent_visit"))
    return s


def demographic_exclusions(stays: DataFrame) -> DataFrame:
    """P6 verbose counts: stays and distinct patients with missing age, missing sex, out of range."""
    miss_age = F.col("age").isNull() | (F.col("age") < 0)
    miss_sex = F.col("sex_cd").isin("Unknown", "U")
    out_range = (F.col("age") >= 0) & (F.col("age_cat") == "Unknown")
    kinds = {"missing_age": miss_age, "missing_sex": miss_sex, "out_of_range": out_range}
    # per patient first, then sums: a stay is not repeated for each distinct count
    per = stays.groupBy("patient_num").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    known = F.col("patient_num").isNotNull()
    return per.agg(*[e for k in kinds for e in (F.coalesce(F.sum(k), F.lit(0)).alias(f"n_stays_{k}"),
                                                F.count_if((F.col(k) > 0) & known).alias(f"n_patients_{k}"))])


def _monthly_aggs(weight_col: str | None, history_col: str | None, rf_cols: list[str]) -> list:
    aggs = [
        F.count("encounter_num").alias("n_sa"),
        F.count_if("death").alias("death"),
        F.avg("duration_seconds").alias("_mean_duration_s"),
    ]
    if history_col:
        aggs.append(F.count_if(history_col).alias("has_history"))
    if weight_col:
        aggs.append(F.sum(weight_col).alias("weighted_n_sa"))
    aggs += [F.count_if(c).alias(c) for c in rf_cols]
    return aggs


def _finish_monthly(df: DataFrame, history_col: str | None, rf_cols: list[str]) -> DataFrame:
    df = df.withColumn("mean_duration", F.col("_mean_duration_s") / F.lit(float(SECONDS_PER_DAY))).drop(
        "_mean_duration_s"
    )
    if history_col:
        df = df.withColumn("has_history_ratio", safe_ratio("has_history", "n_sa"))
    for c in rf_cols:
        df = df.withColumn(f"{c}_ratio", safe_ratio(c, "n_sa"))
    return (
        df.withColumn("month", F.month("date"))
        .withColumn("year", F.year("date"))
        .withColumn("month_name", F.date_format("date", "MMMM"))
        .withColumn("death_ratio", safe_ratio("death", "n_sa"))
    )


def category_grid(months: DataFrame, group_cols: list[str], params: StudyParams = StudyParams()) -> DataFrame:
    """Dense grid months x sexes x age bands, by a generator over the (small, fixed) category
    lists - no join. ``months`` is a DataFrame of distinct ``date`` values."""
    levels = {"sex_cd": list(params.sexes), "age_cat": [lab for _, _, lab in params.age_labels()]}
    combos = [{}]
    for c in group_cols:
        combos = [dict(d, **{c: v}) for d in combos for v in levels[c]]
    arr = F.array(*[F.struct(*[F.lit(d[c]).alias(c) for c in group_cols]) for d in combos])
    return months.select("date", F.inline(arr))


def monthly_table(
    stays: DataFrame,
    group_cols: list[str],
    params: StudyParams = StudyParams(),
    grid: bool | None = None,
    weight_col: str | None = None,
    history_col: str | None = None,
    rf_cols: list[str] = (),
) -> DataFrame:
    """A4: per group x month: n_sa, death, mean_duration (days), optional history / weights /
    RF sums, ratios to n_sa (null on 0), calendar columns.

    With ``grid`` (default when grouping only by sex and/or age band) every month x category
    cell is present, with 0 counts and null ratios for empty cells.
    """
    rf_cols = list(rf_cols)
    keys = list(group_cols) + ["date"]
    agg = stays.groupBy(*keys).agg(*_monthly_aggs(weight_col, history_col, rf_cols))
    if grid is None:
        grid = bool(group_cols) and set(group_cols) <= {"sex_cd", "age_cat"}
    if grid and group_cols:
        # months observed after the filters: taken from the (small) aggregate itself
        months = agg.select("date").distinct()
        cells = category_grid(months, list(group_cols), params)
        agg = cells.join(agg, keys, "left")
        zero_cols = ["n_sa", "death"] + (["has_history"] if history_col else []) + rf_cols
        agg = agg.fillna(0, subset=zero_cols)
    return _finish_monthly(agg, history_col, rf_cols)


GROUPINGS = [[], ["sex_cd"], ["sex_cd", "age_cat"], ["site_label"], ["sex_cd", "age_cat", "site_label"]]


def incidence_grouping_sets(
    stays: DataFrame,
    weight_col: str | None = None,
    history_col: str | None = None,
    rf_cols: list[str] = (),
) -> DataFrame:
    """A5: the monthly table at all five groupings in one aggregate (GROUPING SETS).

    ``grouping_level`` = Spark's grouping_id over (sex_cd, age_cat, site_label)."""
    rf_cols = list(rf_cols)
    cols = ["sex_cd", "age_cat", "site_label"]
    sets = [[F.col(c) for c in g] + [F.col("date")] for g in GROUPINGS]
    agg = stays.groupingSets(sets, *[F.col(c) for c in cols], F.col("date")).agg(
        (F.grouping("sex_cd") * 4 + F.grouping("age_cat") * 2 + F.grouping("site_label")).cast("int").alias(
            "grouping_level"),
        *_monthly_aggs(weight_col, history_col, rf_cols),
    )
    return _finish_monthly(agg, history_col, rf_cols)


def centered_mean(monthly: DataFrame, value: str = "n_sa", by: str = "sex_cd") -> DataFrame:
    """Centred 3-row mean per group over the months in order; null at the edges.

    ``monthly`` must hold one row per (group, month); the 'all' group is part of the input
    (see ``incidence_grouping_sets``)."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-1, 1)
    return monthly.select(
        by, "date", value,
        F.when(F.count(value).over(w) == 3, F.avg(value).over(w)).alias(f"{value}_centered_mean"),
    )


def month_grid(date_from: str, date_to: str) -> str:
    """F5 as a SQL expression: months from date_from (inclusive) to date_to (exclusive)."""
    return (
        f"filter(sequence(date'{date_from}', date'{date_to}', interval 1 month), m -> m < date'{date_to}')"
    )


def months_since(month: str, origin: str):
    """whole months from origin (rounded)."""
    return F.round(F.months_between(F.col(month), F.lit(origin).cast("date"))).cast("int")


def period_shares(stays: DataFrame, by: list[str], params: StudyParams = StudyParams()) -> DataFrame:
    """Per group, stays before / after the cutoff and the share of all stays of the period.

    The window runs over the aggregate (one row per group, a bounded category set)."""
    post = F.col("date") >= F.lit(params.cutoff).cast("date")
    g = stays.groupBy(*by).agg(F.count_if(~post).alias("n_pre"), F.count_if(post).alias("n_post"))
    w = Window.partitionBy()
    return g.withColumn("share_pre", safe_ratio("n_pre", F.sum("n_pre").over(w))).withColumn(
        "share_post", safe_ratio("n_post", F.sum("n_post").over(w))
    )


def stays_per_site(stays: DataFrame, weight_col: str | None = None) -> DataFrame:
    """Stays per site: count, or the rounded sum of weights."""
    if weight_col:
        return stays.groupBy("site_label").agg(F.round(F.sum(weight_col)).alias("n_stays"))
    return stays.groupBy("site_label").agg(F.count(F.lit(1)).alias("n_stays"))


def age_summary(stays: DataFrame) -> DataFrame:
    """Mean and sample std of age."""
    return stays.agg(F.avg("age").alias("mean_age"), F.stddev_samp("age").alias("std_age"),
                     F.count("age").alias("n"))


def outcome_table(stays: DataFrame, by: list[str], all_label: str = "all") -> DataFrame:
    """Per group and over all groups (one aggregate): stays, patients, share of women, age, deaths
    and mean duration in days."""
    g = stays.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n_stays"), F.count_distinct("patient_num").alias("n_patients"),
        F.avg((F.col("sex_cd") == "W").cast("double")).alias("share_women"), F.avg("age").alias("mean_age"),
        F.stddev_samp("age").alias("std_age"), F.count_if("death").alias("n_deaths"),
        (F.avg("duration_seconds") / 86400.0).alias("mean_duration"))
    return g.withColumns({c: F.coalesce(F.col(c), F.lit(all_label)) for c in by})


def completeness_probe(stays_with_notes: DataFrame) -> DataFrame:
    """Per stay 'has a note', then per month x site: n_visit, n_note, rho = n_note / n_visit.

    Input: one row per (stay, candidate note) with ``has_note`` (boolean); the stay level is a
    bool_or so every stay counts once."""
    per_stay = stays_with_notes.groupBy("encounter_num", "date", "site_label").agg(
        F.bool_or("has_note").alias("has_note")
    )
    return per_stay.groupBy("site_label", "date").agg(
        F.count(F.lit(1)).alias("n_visit"), F.count_if("has_note").alias("n_note")
    ).withColumn("rho", safe_ratio("n_note", "n_visit"))


def inverse_weights(probe: DataFrame, params: StudyParams = StudyParams(), sites: list[str] | None = None) -> DataFrame:
    """stay_weight = 1 / rho (null when rho is 0), within the window and the site list."""
    w = probe.where(in_window(params))
    if sites is not None:
        w = w.where(F.col("site_label").isin(*sites))
    return w.withColumn("stay_weight", F.try_divide(F.lit(1.0), F.col("rho")))


def modality_mix(stays: DataFrame, generic_terms: list[str], by: list[str] = ()) -> DataFrame:
    """Share of each term per month (and group).

    Per stay: term counts without generic terms, normalised to 1; a stay with only generic
    terms counts as 'Unknown' = 1. Then summed per month (group) and normalised to 1.
    Long form: (group..., date, term, share).
    """
    by = list(by)
    t = stays.select("encounter_num", "date", *by, F.explode("std_positive_lexical_variants").alias("term"))
    per_stay = t.where(~F.col("term").isin(*generic_terms)).groupBy("encounter_num", "date", *by, "term").agg(
        F.count(F.lit(1)).alias("n")
    )
    w_stay = Window.partitionBy("encounter_num")
    per_stay = per_stay.withColumn("w", F.col("n") / F.sum("n").over(w_stay)).drop("n")
    has_terms = stays.where(F.size("std_positive_lexical_variants") > 0).select("encounter_num", "date", *by)
    unknown = has_terms.join(per_stay.select("encounter_num").distinct(), "encounter_num", "left_anti").select(
        "encounter_num", "date", *by, F.lit("Unknown").alias("term"), F.lit(1.0).alias("w")
    )
    allw = per_stay.unionByName(unknown)
    monthly = allw.groupBy(*by, "date", "term").agg(F.sum("w").alias("w"))
    w_month = Window.partitionBy(*by, "date")
    return monthly.withColumn("share", F.col("w") / F.sum("w").over(w_month)).drop("w")


def slice_stays(stays: DataFrame, age: str | None = None, sex: str | None = None, source: str | None = None) -> DataFrame:
    """Optional slice by age band, sex and outcome source."""
    s = stays
    for col, v in (("age_cat", age), ("sex_cd", sex), ("source", source)):
        if v is not None:
            s = s.where(F.col(col) == F.lit(v))
    return s


def value_share(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """Share of true values, nulls excluded (normalised value count of a boolean)."""
    return df.groupBy(*by).agg(F.avg(F.col(col).cast("double")).alias(f"{col}_share"),
                               F.count(col).alias("n_known"))
