"""2x2 contingency per risk factor (A12) and the risk ratio with CI and exact test (T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.columns import fisher_two_sided
from cohortspark.functions.stats import Z975
from cohortspark.params import StudyParams


def contingency(stays: DataFrame, rf_cols: list[str], by: list[str] = (), params: StudyParams = StudyParams(),
                all_label: str | None = "all") -> DataFrame:
    """A12, long form: per (group, rf) the counts a = rf & post, b = rf & pre,
    c = no rf & post, d = no rf & pre. One unpivot + one aggregate for all RFs; with
    ``all_label`` the all-groups rows come from the same aggregate (grouping sets)."""
    by = list(by)
    post = F.col("date") >= F.lit(params.cutoff).cast("date")
    long = stays.withColumn("_post", post).unpivot(by + ["_post"], rf_cols, "rf_name", "_rf")
    long = long.withColumn("_rf", F.coalesce(F.col("_rf").cast("boolean"), F.lit(False)))
    aggs = [
        F.count_if(F.col("_rf") & F.col("_post")).alias("a"),
        F.count_if(F.col("_rf") & ~F.col("_post")).alias("b"),
        F.count_if(~F.col("_rf") & F.col("_post")).alias("c"),
        F.count_if(~F.col("_rf") & ~F.col("_post")).alias("d"),
    ]
    if not by or all_label is None:
        return long.groupBy(*by, "rf_name").agg(*aggs)
    sets = [[F.col(c) for c in by] + [F.col("rf_name")], [F.col("rf_name")]]
    g = long.groupingSets(sets, *[F.col(c) for c in by], F.col("rf_name")).agg(*aggs)
    for c in by:
        g = g.withColumn(c, F.coalesce(F.col(c), F.lit(all_label)))
    return g


def risk_ratio(table: DataFrame, keys: list[str]) -> DataFrame:
    """T5: RR = P(rf | post) / P(rf | pre) with a log-normal 95% CI; null when a cell makes it
    undefined, and Fisher's two-sided exact p. Works on the aggregated 2x2 rows; not rounded."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    rr = (a / (a + c)) / (b / (b + d))
    se = F.sqrt(1 / a - 1 / (a + c) + 1 / b - 1 / (b + d))
    ok = (F.col("a") > 0) & (F.col("b") > 0)
    out = table.select(*keys, "a", "b", "c", "d").withColumn("risk_ratio", F.when(ok, rr)).withColumn("_se", F.when(ok, se))
    out = out.withColumn("rr_lower", F.exp(F.log("risk_ratio") - Z975 * F.col("_se"))).withColumn(
        "rr_upper", F.exp(F.log("risk_ratio") + Z975 * F.col("_se"))).drop("_se")
    return out.withColumn("fisher_p", fisher_two_sided("a", "b", "c", "d"))
