"""Interrupted time series (T1-T4) as group-wise aggregates.

Model per group: y = const + b_t * t + b_d * delta_t + sum_k m_k * [month = k] + e, over the
complete month grid of the study window (missing months count 0). With a constant and all
twelve month indicators the design has rank 14 of 15; the minimum-norm least-squares solution
(what a pseudo-inverse returns) is computed in closed form:

  slopes  = 2x2 normal equations on t, delta_t, y demeaned within calendar month
  a_k     = mean_k(y) - b_t mean_k(t) - b_d mean_k(delta_t)
  const   = sum_k a_k / 13,  m_k = a_k - const
  s^2     = SSR / (n - 14);  Var(slopes) = s^2 Z^-1
  Var(const) = s^2 / 169 * (sum_k 1/n_k + w' Z^-1 w),  w = (sum_k mean_k t, sum_k mean_k delta_t)

Everything is a sum over the group's rows, so a fit is a handful of partial aggregates; a
group with many months never moves to one task as a list.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.stats import t_ppf
from cohortspark.params import StudyParams

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]


def _months_between(a: str, b: str) -> int:
    da, db = dt.date.fromisoformat(a), dt.date.fromisoformat(b)
    return (db.year - da.year) * 12 + (db.month - da.month)


def window_months(params: StudyParams) -> int:
    return _months_between(params.date_from, params.date_upper_limit)


def cutoff_t(params: StudyParams) -> int:
    """t of the first month on or after the cutoff (months are whole, from date_from)."""
    c = dt.date.fromisoformat(params.cutoff)
    first = c if c.day == 1 else (dt.date(c.year + (c.month == 12), c.month % 12 + 1, 1))
    return _months_between(params.date_from, first.isoformat())


def design(monthly: DataFrame, keys: list[str], params: StudyParams = StudyParams(), y: str = "n_sa") -> DataFrame:
    """Complete month grid per group (0 for missing), t, after, delta_t, month index.

    The grid is generated per group from the window parameters (a generator, no join with a
    calendar table); ``observed`` marks months present in the input."""
    if not keys:
        monthly, keys = monthly.withColumn("series", F.lit("all")), ["series"]
    months = F.expr(
        f"sequence(date'{params.date_from}', add_months(date'{params.date_upper_limit}', -1), interval 1 month)"
    )
    groups = monthly.select(*keys).distinct()
    grid = groups.select(*keys, F.explode(months).alias("date"))
    obs = monthly.select(*keys, "date", F.col(y).cast("double").alias("y"), F.lit(True).alias("observed"))
    d = grid.join(obs, keys + ["date"], "left").fillna({"y": 0.0, "observed": False})
    t = F.round(F.months_between("date", F.lit(params.date_from).cast("date"))).cast("int")
    t_ob = cutoff_t(params)
    after = F.col("date") >= F.lit(params.cutoff).cast("date")
    return (
        d.withColumn("t", t)
        .withColumn("after_cutoff", after.cast("int"))
        .withColumn("delta_t", F.when(after, F.col("t") - F.lit(t_ob)).otherwise(F.lit(0)))
        .withColumn("month_index", F.month("date"))
    )


def _fit(des: DataFrame, keys: list[str]) -> DataFrame:
    """Per design row: the group's slopes, a_k, const, s^2 and standard errors.

    All statistics are window aggregates over partitions by group (and group x month); a
    hash partitioning on the group satisfies both, so the whole fit costs one shuffle. Sums
    over distinct months are row sums weighted by 1 / n_k."""
    w_g = Window.partitionBy(*keys)
    w_k = Window.partitionBy(*keys, "month_index")
    x = (
        des.withColumn("n_k", F.count(F.lit(1)).over(w_k))
        .withColumn("mt", F.avg("t").over(w_k))
        .withColumn("md", F.avg("delta_t").over(w_k))
        .withColumn("my", F.avg("y").over(w_k))
    )
    tt, dd, yy = F.col("t") - F.col("mt"), F.col("delta_t") - F.col("md"), F.col("y") - F.col("my")
    for name, e in [("stt", tt * tt), ("std", tt * dd), ("sdd", dd * dd), ("sty", tt * yy), ("sdy", dd * yy)]:
        x = x.withColumn(name, F.sum(e).over(w_g))
    x = x.withColumn("n", F.count(F.lit(1)).over(w_g))
    det = F.col("stt") * F.col("sdd") - F.col("std") * F.col("std")
    x = x.withColumn("det", F.when(F.abs(det) > 1e-9, det))
    x = x.withColumn("b_t", (F.col("sdd") * F.col("sty") - F.col("std") * F.col("sdy")) / F.col("det")).withColumn(
        "b_d", (F.col("stt") * F.col("sdy") - F.col("std") * F.col("sty")) / F.col("det"))
    x = x.withColumn("a_k", F.col("my") - F.col("b_t") * F.col("mt") - F.col("b_d") * F.col("md"))
    x = (
        x.withColumn("const", F.sum(F.col("a_k") / F.col("n_k")).over(w_g) / 13.0)
        .withColumn("sum_inv_n", F.sum(1.0 / (F.col("n_k") * F.col("n_k"))).over(w_g))
        .withColumn("w_t", F.sum(F.col("mt") / F.col("n_k")).over(w_g))
        .withColumn("w_d", F.sum(F.col("md") / F.col("n_k")).over(w_g))
    )
    res = F.col("y") - F.col("a_k") - F.col("b_t") * F.col("t") - F.col("b_d") * F.col("delta_t")
    x = x.withColumn("ssr", F.sum(res * res).over(w_g))
    x = x.withColumn("s2", F.when(F.col("n") > 14, F.col("ssr") / (F.col("n") - 14)))
    # Z^-1 = [[sdd, -std], [-std, stt]] / det
    quad = (F.col("w_t") * F.col("w_t") * F.col("sdd") - 2 * F.col("w_t") * F.col("w_d") * F.col("std")
            + F.col("w_d") * F.col("w_d") * F.col("stt")) / F.col("det")
    return (
        x.withColumn("se_t", F.sqrt(F.col("s2") * F.col("sdd") / F.col("det")))
        .withColumn("se_d", F.sqrt(F.col("s2") * F.col("stt") / F.col("det")))
        .withColumn("se_const", F.sqrt(F.col("s2") / 169.0 * (F.col("sum_inv_n") + quad)))
    )


def _keys(keys) -> list[str]:
    return list(keys) or ["series"]


def coefficients(des: DataFrame, keys: list[str] = (), params: StudyParams = StudyParams()) -> DataFrame:
    """Long table (group..., term, estimate, std_error, lower, upper) with terms
    const, t, delta_t and the twelve months. CI: t quantile at n - 14 degrees of freedom."""
    keys = _keys(keys)
    x = _fit(des, keys)
    dof = window_months(params) - 14
    q = t_ppf(0.975, dof) if dof > 0 else None   # fewer than 15 months: no residual variance
    g = x.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ["const", "se_const", "b_t", "se_t", "b_d", "se_d"]])
    main = g.select(*keys, F.inline(F.array(
        F.struct(F.lit("const").alias("term"), F.col("const").alias("estimate"), F.col("se_const").alias("std_error")),
        F.struct(F.lit("t").alias("term"), F.col("b_t").alias("estimate"), F.col("se_t").alias("std_error")),
        F.struct(F.lit("delta_t").alias("term"), F.col("b_d").alias("estimate"), F.col("se_d").alias("std_error")),
    )))
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("month_index"))
    months = x.groupBy(*keys, "month_index").agg(F.first(F.col("a_k") - F.col("const")).alias("estimate")).select(
        *keys, name.alias("term"), "estimate", F.lit(None).cast("double").alias("std_error"))
    out = main.unionByName(months)
    qc = F.lit(q).cast("double")
    return out.withColumn("lower", F.col("estimate") - qc * F.col("std_error")).withColumn(
        "upper", F.col("estimate") + qc * F.col("std_error"))


def fitted(des: DataFrame, keys: list[str] = ()) -> DataFrame:
    """T2 decomposition on the observed months: estimate, residual, linear trend
    (b_t t + b_d delta_t + const) and the no-change trend (b_t t + const)."""
    keys = _keys(keys)
    x = _fit(des, keys).where("observed")
    est = F.col("a_k") + F.col("b_t") * F.col("t") + F.col("b_d") * F.col("delta_t")
    out = x.select(
        *keys, "date", "y", "t", "delta_t",
        est.alias("estimate"),
        (F.col("y") - est).alias("residual"),
        (F.col("b_t") * F.col("t") + F.col("b_d") * F.col("delta_t") + F.col("const")).alias("linear_trend"),
        (F.col("b_t") * F.col("t") + F.col("const")).alias("no_change_trend"),
    )
    return out


def trend_change(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """T4: the delta_t slope change with its CI and half-widths, per group."""
    d = coefs.where(F.col("term") == "delta_t")
    return d.select(
        *keys, F.col("estimate").alias("delta_t"), "lower", "upper",
        (F.col("estimate") - F.col("lower")).alias("lower_half_width"),
        (F.col("upper") - F.col("estimate")).alias("upper_half_width"),
    )



def fit_sets(stays: DataFrame, sets: dict[str, list[str]], params: StudyParams = StudyParams(), term_names: tuple = ("const", "t", "delta_t")) -> DataFrame:
    """The interrupted-time-series fit of every group of every grouping at once.

    ``sets`` names groupings by their columns. The stays are counted once, per cell of all columns and month;
    the cells are dealt to the groupings, and one fit keyed by (grouping, columns) gives a row per group: stays, share
    of all stays, mean age and the terms with their intervals. A column that a grouping leaves out is 'all'."""
    cols = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    cells = stays.groupBy(*cols, "date").agg(F.count(F.lit(1)).alias("n"), F.sum("age").alias("age"), F.count("age").alias("n_age"))
    pick = F.array(*[F.struct(F.lit(name).alias("grouping"), *[(F.col(c).cast("string") if c in cs else F.lit("all")).alias(c) for c in cols])
                     for name, cs in sets.items()])
    x = cells.select(F.explode(pick).alias("g"), "date", "n", "age", "n_age").select("g.*", "date", "n", "age", "n_age")
    keys = ["grouping", *cols]
    monthly = x.groupBy(*keys, "date").agg(F.sum("n").alias("n_sa"), F.sum("age").alias("age"), F.sum("n_age").alias("n_age"))
    sums = monthly.groupBy(*keys).agg(F.sum("n_sa").alias("n_stays"), (F.sum("age") / F.sum("n_age")).alias("mean_age"))
    total = Window.partitionBy("grouping")
    sums = sums.withColumn("share", F.col("n_stays") / F.sum("n_stays").over(total))
    coefs = coefficients(design(monthly, keys, params), keys, params).where(F.col("term").isin(*term_names))
    value = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    wide = coefs.groupBy(*keys).agg(*[value(t, c).alias(t if c == "estimate" else f"{t}_{c}") for t in term_names for c in ("estimate", "lower", "upper")])
    return sums.join(wide, keys)
