"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.params import SECONDS_PER_YEAR, StudyParams

QUALIFIERS = ("negation", "family", "history", "hypothesis", "rspeech")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start, end) -> Column:
    """end - start in seconds; works for timestamp_ntz and dates."""
    return F.timestamp_diff("SECOND", col(start).cast("timestamp_ntz"), col(end).cast("timestamp_ntz"))


def age_years(birth="birth_date", at="visit_start_date") -> Column:
    """floor(elapsed seconds / mean Gregorian year)."""
    return F.floor(seconds_between(birth, at) / F.lit(SECONDS_PER_YEAR)).cast("int")


def age_band(age="age", params: StudyParams = StudyParams()) -> Column:
    """Right-closed bands (lo, hi] labelled 'lo+1-hi'; anything else is 'Unknown'."""
    a = col(age)
    expr = None
    for lo, hi, label in params.age_labels():
        cond = (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("Unknown"))


def age_band_order(band="age_cat", params: StudyParams = StudyParams()) -> Column:
    """O1: sort key of the band labels (Unknown last)."""
    b = col(band)
    expr = None
    for i, (_, _, label) in enumerate(params.age_labels()):
        expr = F.when(b == label, F.lit(i)) if expr is None else expr.when(b == label, F.lit(i))
    return expr.otherwise(F.lit(len(params.age_labels())))


def month_start(ts="visit_start_date") -> Column:
    return F.trunc(col(ts), "MM")


def any_of(cols) -> Column:
    """OR over boolean columns, null counting as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(col(c), F.lit(False)) for c in cols])


def mention_flag(method: str = "full") -> Column:
    """A mention counts unless qualified away.

    method 'rf': not (negation or hypothesis); otherwise none of the five qualifiers.
    """
    if method == "rf":
        return ~any_of(["negation", "hypothesis"])
    return ~any_of(list(QUALIFIERS))


def history_flag() -> Column:
    """Personal history: history and not (negation, family, hypothesis)."""
    return F.coalesce(F.col("history"), F.lit(False)) & ~any_of(["negation", "family", "hypothesis"])


def death_flag(mode="discharge_mode", params: StudyParams = StudyParams()) -> Column:
    """P14"""
    return F.coalesce(col(mode) == F.lit(params.discharge_death), F.lit(False))


def after_cutoff(month="date", params: StudyParams = StudyParams()) -> Column:
    """P16"""
    return col(month) >= F.lit(params.cutoff).cast("date")


def safe_ratio(num, den) -> Column:
    """ratio, null when the denominator is 0 or null."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def erfc(x) -> Column:
    """Complementary error function of a result column (one value per test, never per stay)."""
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        import math

        return v.map(lambda t: None if t is None or t != t else math.erfc(t))

    return run(col(x).cast("double"))


def fisher_two_sided(a, b, c, d) -> Column:
    """Two-sided Fisher exact p of a 2x2 table (one row per risk factor and group).

    The probabilities of the tables with the same margins are walked outwards from the most
    probable one by their exact ratios, in logs and in pieces, until they vanish (about 40 standard
    deviations); their own sum normalises them. So neither large counts nor large margins lose
    digits or need an array over all tables. A p below the smallest double is 0."""
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        import numpy as np

        def walk(x, step, r1, r2, c1, low, high):
            at, piece = 0.0, 1 << 16
            while low <= x + step <= high and at > -745:
                n = min(piece, (high - x) if step > 0 else (x - low))
                k = np.arange(n, dtype=np.float64)
                if step > 0:  # from x + k to x + k + 1
                    ratio = (r1 - x - k) / (x + k + 1) * ((c1 - x - k) / (r2 - c1 + x + k + 1))
                else:
                    ratio = (x - k) / (r1 - x + k + 1) * ((r2 - c1 + x - k) / (c1 - x + k + 1))
                logs = at + np.cumsum(np.log(ratio))
                yield x, logs
                x, at = x + step * n, float(logs[-1])

        def p_value(a, b, c, d):
            if any(v is None or v != v for v in (a, b, c, d)):
                return None
            a, b, c, d = int(a), int(b), int(c), int(d)
            r1, r2, c1 = a + b, c + d, a + c
            low, high = max(0, c1 - r2), min(r1, c1)
            mode = min(max((r1 + 1) * (c1 + 1) // (r1 + r2 + 2), low), high)
            step = 1 if a > mode else -1
            seen = 0.0 if a == mode else None
            for x, logs in walk(mode, step, r1, r2, c1, low, high):
                if seen is None and 0 < (a - x) * step <= len(logs):
                    seen = float(logs[(a - x) * step - 1])
            if seen is None:
                return 0.0
            total, rare = 1.0, 1.0 if seen + 1e-7 >= 0 else 0.0
            for s in (1, -1):
                for _, logs in walk(mode, s, r1, r2, c1, low, high):
                    rel = np.exp(logs)
                    total += float(rel.sum())
                    rare += float(rel[logs <= seen + 1e-7].sum())
            return min(1.0, rare / total)

        return pd.Series([p_value(*v) for v in zip(a, b, c, d)], dtype="float64")

    return run(*(col(x).cast("long") for x in (a, b, c, d)))
