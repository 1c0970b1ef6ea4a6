import datetime as dt
import hashlib

from pyspark.sql import functions as F

from cohortspark.operators import agreement, sampling, survival


def test_km_hand_case(spark):
    rows = [("pre", 1.0, True), ("pre", 2.0, False), ("pre", 2.0, True), ("pre", 3.0, True),
            ("post", 0.0, True), ("post", 5.0, False)]
    km = spark.createDataFrame(rows, "cohort string, duration double, event boolean")
    c = {(r.cohort, r.duration): (r.n_at_risk, r.survival) for r in survival.km_curve(km).collect()}
    assert c[("pre", 1.0)] == (4, 0.75)
    assert c[("pre", 2.0)][0] == 3 and abs(c[("pre", 2.0)][1] - 0.75 * (2 / 3)) < 1e-12
    assert c[("pre", 3.0)] == (1, 0.0)                   # d = n at the last time
    assert c[("post", 0.0)] == (2, 0.5)                  # duration 0
    lr = survival.logrank(km).first()
    # by hand: times 0 (d=1,n1=4,n2=2), 1 (d=1,n1=4,n2=1), 2 (d=1,n1=3,n2=1), 3 (d=1,n1=1,n2=1)
    e1 = 1 * 4 / 6 + 1 * 4 / 5 + 1 * 3 / 4 + 1 * 1 / 2
    v = (4 * 2 * 5 / (36 * 5)) + (4 * 1 * 4 / (25 * 4)) + (3 * 1 * 3 / (16 * 3)) + (1 * 1 * 1 / (4 * 1))
    assert lr.observed_1 == 3 and abs(lr.expected_1 - e1) < 1e-9
    assert abs(lr.chi2 - (3 - e1) ** 2 / v) < 1e-9


def test_logrank_of_many_stays(spark):
    """Products of four counts of 100,000 stays are beyond the longs (F1, F2)."""
    n = 200_000
    km = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "pre").otherwise("post").alias("cohort"),
        F.when((F.col("id") % 4 == 0) | (F.col("id") % 8 == 1), 1.0).otherwise(2.0).alias("duration"), F.lit(True).alias("event"))
    lr = survival.logrank(km).first()
    # time 1: d = 75,000 of 100,000 + 100,000 at risk; time 2: all 125,000 left, 50,000 of them first
    h = 100_000
    e1 = 75_000 * h / n + 125_000 * 50_000 / 125_000
    v = 75_000 * h * h * (n - 75_000) / (n * n * (n - 1))
    assert lr.observed_1 == h and abs(lr.expected_1 - e1) < 1e-6
    assert abs(lr.chi2 / ((h - e1) ** 2 / v) - 1) < 1e-9
    assert lr.p_value == 0.0  # beyond the smallest double


def test_all_censored(spark):
    km = spark.createDataFrame([("pre", 1.0, False), ("pre", 2.0, False)], "cohort string, duration double, event boolean")
    assert {r.survival for r in survival.km_curve(km).collect()} == {1.0}


def test_kappa_and_agreement(spark):
    def wide(pairs):
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "note_id long, A boolean, B boolean")

    assert agreement.cohen_kappa(wide([(True, True), (False, False)])).first().kappa == 1.0
    assert agreement.cohen_kappa(wide([(True, False), (False, True)])).first().kappa == -1.0
    assert agreement.cohen_kappa(wide([(True, True), (True, True)])).first().kappa is None  # one class only
    ca = agreement.class_agreement(wide([(True, True), (True, False), (False, False)])).first()
    assert abs(ca.positive_agreement - 2 / 3) < 1e-12 and abs(ca.negative_agreement - 2 / 3) < 1e-12


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k long, n long")
    p, lo, hi = agreement.wilson("k", "n")
    r = df.select(p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect()
    assert r[0].p == 0.0 and abs(r[0].lo) < 1e-12 and 0 < r[0].hi < 0.35
    assert r[1].p == 1.0 and abs(r[1].hi - 1.0) < 1e-12 and 0.65 < r[1].lo < 1
    assert r[2].p is None and r[2].lo is None


def test_stratified_sample_two_phase(spark):
    rows = [(i, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "note_id long, post boolean")
    got = {(r.post, r.note_id) for r in sampling.stratified_sample(df, ["post"], 25).collect()}
    want = set()
    for post in (True, False):
        ids = sorted([i for i, p in rows if p == post], key=lambda i: (hashlib.md5(f"7919-{i}".encode()).hexdigest(), i))[:25]
        want |= {(post, i) for i in ids}
    assert got == want
    small = sampling.stratified_sample(df.where("note_id < 4"), ["post"], 25).count()
    assert small == 4                                     # stratum smaller than n


def test_allocation_shares(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "note_id long")
    all_shared = sampling.allocate(df, ["A", "B"], 1.0).count()
    assert all_shared == 20
    none_shared = sampling.allocate(df, ["A", "B"], 0.0)
    assert none_shared.count() == 10 and none_shared.where("annotator = 'A'").count() == 5
    assert sampling.allocate(df, ["A"], 0.3).count() == 10


def test_negative_durations_are_never_at_risk(spark):
    km = spark.createDataFrame([("pre", -2.5, False), ("pre", 0.5, True), ("pre", 40.0, True)], "cohort string, duration double, event boolean")
    got = {r.day: r.n_at_risk for r in survival.at_risk_days(km, 3).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1}


def test_km_and_logrank_over_many_days_match_brute_force(spark):
    rng = __import__("random").Random(3)
    rows = [(c, rng.randint(0, 400) / 10, rng.random() < 0.7) for c in ("pre", "post") for _ in range(150)]
    km = spark.createDataFrame(rows, "cohort string, duration double, event boolean")
    for r in survival.km_curve(km).collect():
        s = 1.0
        for t in sorted({d for c, d, _ in rows if c == r.cohort and d <= r.duration}):
            n = sum(c == r.cohort and d >= t for c, d, _ in rows)
            s *= 1 - sum(c == r.cohort and d == t and e for c, d, e in rows) / n
        assert abs(r.survival - s) < 1e-9
    e1 = v = 0.0
    for t in sorted({d for _, d, _ in rows}):
        n1, n2 = (sum(c == x and d >= t for c, d, _ in rows) for x in ("pre", "post"))
        n, d = n1 + n2, sum(x == t and e for _, x, e in rows)
        e1 += d * n1 / n
        v += d * n1 * n2 * (n - d) / (n * n * (n - 1)) if n > 1 else 0
    obs = sum(e for c, _, e in rows if c == "pre")
    got = survival.logrank(km).first()
    assert abs(got.chi2 - (obs - e1) ** 2 / v) < 1e-9


def test_order_key_is_uniform(spark):
    """The first of a million ids in key order are spread over the whole range of ids."""
    ids = [r.id for r in spark.range(1_000_000).orderBy(sampling.order_key("id"), "id").limit(2000).collect()]
    tenths = [sum(k * 100_000 <= i < (k + 1) * 100_000 for i in ids) for k in range(10)]
    assert min(tenths) > 140 and max(tenths) < 260
    big = spark.createDataFrame([(4 * 10**18,), (-1,)], "note_id long")
    assert sampling.stratified_sample(big.selectExpr("note_id", "1 AS s"), ["s"], 2).count() == 2
