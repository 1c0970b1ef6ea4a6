import datetime as dt
import math
import random

import numpy as np

from cohortspark.functions.stats import fisher_exact_two_sided, t_ppf
from cohortspark.operators import its
from cohortspark.params import StudyParams


def test_t_quantiles():
    for df, want in [(1, 12.706204736), (5, 2.570581836), (10, 2.228138852), (30, 2.042272456), (100, 1.983971519)]:
        assert abs(t_ppf(0.975, df) - want) < 1e-6


def test_fisher_known_tables():
    assert abs(fisher_exact_two_sided(3, 1, 1, 3) - 0.4857142857) < 1e-9
    assert abs(fisher_exact_two_sided(8, 2, 1, 5) - 0.0349650350) < 1e-9
    assert fisher_exact_two_sided(0, 0, 0, 0) == 1.0


def _months(p):
    d0 = dt.date.fromisoformat(p.date_from)
    return [dt.date(d0.year + (d0.month - 1 + i) // 12, (d0.month - 1 + i) % 12 + 1, 1) for i in range(its.window_months(p))]


def test_closed_form_equals_pinv(spark):
    p = StudyParams(date_from="2017-08-01", date_upper_limit="2022-07-01", cutoff="2020-03-01")
    rng = random.Random(4)
    months = _months(p)
    rows = [(g, m, float(rng.randint(0, 40))) for g in ("x", "y") for m in months if rng.random() < 0.9]
    monthly = spark.createDataFrame(rows, "grp string, date date, n_sa double")
    des = its.design(monthly, ["grp"], p)
    coefs = {(r.grp, r.term): r.estimate for r in its.coefficients(des, ["grp"], p).collect()}
    ses = {(r.grp, r.term): r.std_error for r in its.coefficients(des, ["grp"], p).collect()}
    t_ob = its.cutoff_t(p)
    for g in ("x", "y"):
        y = {m: v for gg, m, v in rows if gg == g}
        X, Y = [], []
        for i, m in enumerate(months):
            after = m >= dt.date.fromisoformat(p.cutoff)
            X.append([1.0, i, (i - t_ob) if after else 0] + [1.0 if m.month == k else 0.0 for k in range(1, 13)])
            Y.append(y.get(m, 0.0))
        X, Y = np.array(X), np.array(Y)
        beta = np.linalg.pinv(X) @ Y
        assert abs(beta[0] - coefs[(g, "const")]) < 1e-6
        assert abs(beta[1] - coefs[(g, "t")]) < 1e-6
        assert abs(beta[2] - coefs[(g, "delta_t")]) < 1e-6
        for k, name in enumerate(its.MONTHS):
            assert abs(beta[3 + k] - coefs[(g, name)]) < 1e-6
        resid = Y - X @ beta
        s2 = resid @ resid / (len(Y) - 14)
        cov = s2 * np.linalg.pinv(X.T @ X)
        assert abs(math.sqrt(cov[2, 2]) - ses[(g, "delta_t")]) < 1e-6
        assert abs(math.sqrt(cov[1, 1]) - ses[(g, "t")]) < 1e-6
        assert abs(math.sqrt(cov[0, 0]) - ses[(g, "const")]) < 1e-6


def test_cutoff_outside_window_is_null(spark):
    p = StudyParams(date_from="2017-08-01", date_upper_limit="2018-08-01", cutoff="2030-01-01")
    monthly = spark.createDataFrame([("x", m, 1.0) for m in _months(p)], "grp string, date date, n_sa double")
    c = {r.term: r.estimate for r in its.coefficients(its.design(monthly, ["grp"], p), ["grp"], p).collect()}
    assert c["delta_t"] is None


def test_native_fisher_matches_python(spark):
    import random

    from cohortspark.functions.columns import fisher_two_sided

    rng = random.Random(9)
    rows = [(rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 30)) for _ in range(200)]
    rows += [(0, 0, 0, 0), (3, 1, 1, 3), (8, 2, 1, 5), (500, 20, 430, 60)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select("a", "b", "c", "d", fisher_two_sided("a", "b", "c", "d").alias("p")).collect()
    for r in got:
        assert abs(r.p - fisher_exact_two_sided(r.a, r.b, r.c, r.d)) < 1e-9


def test_native_fisher_at_large_counts(spark):
    """With two cells far larger than the others the p-value is the binomial one; huge cells return a value."""
    from cohortspark.functions.columns import fisher_two_sided

    rows = [(5, 10, c, c) for c in (10**6, 10**8, 10**9)] + [(1_500_000_000, 1_500_000_000, 1_500_000_000, 1_500_000_000),
                                                          (10**6, 0, 0, 10**6), (0, 0, 0, 0)]
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(
        fisher_two_sided("a", "b", "c", "d").alias("p")).collect()]
    want = 2 * sum(math.comb(15, k) for k in range(6)) / 2**15
    assert all(abs(p - want) < 1e-4 for p in got[:3]) and abs(got[3] - 1) < 1e-9 and got[4] == 0.0 and got[5] == 1.0


def test_its_keeps_nothing_cached(spark):
    p = StudyParams()
    monthly = spark.createDataFrame([("x", dt.date(1996, 1, 1), 3.0)], "grp string, date date, n_sa double")
    its.coefficients(its.design(monthly, ["grp"], p), ["grp"], p).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
