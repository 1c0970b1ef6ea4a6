import datetime as dt
import itertools

from pyspark.sql import functions as F

from cohortspark.functions.columns import history_flag, mention_flag
from cohortspark.operators import cohort, incidence, risk, stays
from cohortspark.params import StudyParams
from cohortspark.sources import adapters

D = dt.datetime(2020, 1, 1)


def test_keep_one_note_edges(spark):
    rows = [
        (1, 10, "src5", D),                          # known, earlier
        (2, 10, "src0", D + dt.timedelta(days=3)),   # unknown category later: known wins
        (3, 11, "src4", D), (4, 11, "src7", D),      # equal times: larger note id
        (5, 12, None, D + dt.timedelta(days=9)),     # null category counts as unknown
        (6, 12, "src2", D),
    ]
    n = spark.createDataFrame(rows, "note_id long, encounter_num long, note_category string, document_datetime timestamp_ntz")
    last = {r.encounter_num: (r.note_id, r.n_docs_per_visit) for r in cohort.select_one_note(n, "keep_last").collect()}
    first = {r.encounter_num: r.note_id for r in cohort.select_one_note(n, "keep_first").collect()}
    assert last == {10: (1, 2), 11: (4, 2), 12: (6, 2)}
    assert first == {10: 1, 11: 4, 12: 6}
    import pytest

    with pytest.raises(ValueError):
        cohort.select_one_note(n, "keep_middle")


def test_mention_flag_all_combinations(spark):
    names = ["negation", "family", "history", "hypothesis", "rspeech"]
    rows = [c for c in itertools.product([True, False], repeat=5)] + [(None,) * 5]
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names))
    out = df.select(*names, mention_flag().alias("full"), mention_flag("rf").alias("rf"), history_flag().alias("hist")).collect()
    for r in out:
        v = {n: bool(r[n]) for n in names}
        assert r.full == (not any(v.values()))
        assert r.rf == (not (v["negation"] or v["hypothesis"]))
        assert r.hist == (v["history"] and not (v["negation"] or v["family"] or v["hypothesis"]))


def test_incidence_grid_zero_cells(spark):
    rows = [(1, "M", "18-25", dt.date(2020, 1, 1), False, 86400.0),
            (2, "W", "26-65", dt.date(2020, 3, 1), True, None)]
    st = spark.createDataFrame(rows, "encounter_num long, sex_cd string, age_cat string, date date, death boolean, duration_seconds double")
    t = {(r.sex_cd, r.age_cat, r.date): r for r in incidence.monthly_table(st, ["sex_cd", "age_cat"]).collect()}
    assert len(t) == 2 * 2 * 4                     # observed months x sexes x bands
    empty = t[("W", "8-17", dt.date(2020, 1, 1))]
    assert empty.n_sa == 0 and empty.death == 0 and empty.death_ratio is None and empty.mean_duration is None
    assert t[("M", "18-25", dt.date(2020, 1, 1))].mean_duration == 1.0
    assert t[("W", "26-65", dt.date(2020, 3, 1))].death_ratio == 1.0


def test_weights_rho_zero_and_missing(spark):
    probe = spark.createDataFrame([("A", dt.date(2020, 1, 1), 4, 0, 0.0), ("A", dt.date(2020, 2, 1), 4, 2, 0.5)],
                                  "site_label string, date date, n_visit long, n_note long, rho double")
    w = incidence.inverse_weights(probe, StudyParams(date_from="2019-01-01", date_upper_limit="2021-01-01"))
    st = spark.createDataFrame([(1, dt.date(2020, 1, 1), "A"), (2, dt.date(2020, 2, 1), "A"), (3, dt.date(2020, 5, 1), "A")],
                               "encounter_num long, date date, site_label string")
    got = {r.encounter_num: r.stay_weight for r in stays.add_weights(st, w).collect()}
    assert got == {1: None, 2: 2.0, 3: None}


def test_risk_ratio_zero_cells(spark):
    t = spark.createDataFrame([("x", 0, 5, 3, 7), ("y", 2, 0, 3, 7), ("z", 4, 2, 6, 8)], "rf_name string, a long, b long, c long, d long")
    got = {r.rf_name: r for r in risk.risk_ratio(t, ["rf_name"]).collect()}
    assert got["x"].risk_ratio is None and got["x"].rr_lower is None
    assert got["y"].risk_ratio is None
    assert abs(got["z"].risk_ratio - (4 / 10) / (2 / 10)) < 1e-12 and got["z"].fisher_p is not None


def test_modality_mix_cases(spark):
    rows = [(1, dt.date(2020, 1, 1), ["with", "with"]),        # only generic -> Unknown
            (2, dt.date(2020, 1, 1), ["dans", "with", "dans"]),  # mixed, one term twice
            (3, dt.date(2020, 1, 1), ["avec"]),
            (4, dt.date(2020, 1, 1), None)]                      # null list: not counted
    st = spark.createDataFrame(rows, "encounter_num long, date date, std_positive_lexical_variants array<string>")
    got = {r.term: round(r.share, 9) for r in incidence.modality_mix(st, ["with"]).collect()}
    assert got == {"Unknown": round(1 / 3, 9), "dans": round(1 / 3, 9), "avec": round(1 / 3, 9)}
    assert abs(sum(got.values()) - 1) < 1e-9


def test_late_text_read_equals_the_filter_after_the_choice(spark):
    rows = [(1, 10, 5, "a", "pain here"), (2, 10, 6, "a", "none"), (3, 10, 4, None, "pain"), (4, 11, 5, "b", None), (5, 11, 5, "b", "Pain, home"),
            (6, 12, None, "b", "home"), (7, None, 5, "b", "pain"), (8, 13, 5, "b", ""), (9, 14, 5, "src0", "pain"), (10, 14, 4, "b", "nothing")]
    n = spark.createDataFrame(rows, "note_id long, encounter_num long, day int, note_category string, note_text string").select(
        "note_id", "encounter_num", "note_category", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(day)").alias("document_datetime"), "note_text")
    words = {"p": "(?i)pain", "h": "home"}
    for method in ("keep_last", "keep_first"):
        late = cohort.select_note_texts(n, words, method)
        plain = cohort.regex_filter(cohort.select_one_note(n, method), words)
        assert sorted(map(str, late.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert cohort.select_note_texts(n.where("false"), words).collect() == []


def test_no_aggregate_holds_a_text(spark):
    n = adapters.notes(spark, "/root/testdata/sf0.001")
    plan = cohort.select_note_texts(n, {"w": "with"})._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert aggregates and not any("text" in line for line in aggregates)
    filters = [line for line in plan.splitlines() if "RLIKE" in line or "rlike" in line.lower()]
    assert filters


def test_texts_dealt_by_stay_are_not_shuffled_again(spark):
    """The chosen notes' texts are joined by stay, as the join with the stays has dealt them (F16)."""
    n = adapters.notes(spark, "/root/testdata/sf0.001")
    words = {"w": "with"}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plans = [cohort.select_note_texts(n, words, by_stay=b) for b in (False, True)]
        exchanges = [p._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for p in plans]
        assert exchanges[1] == exchanges[0] - 2
        rows = [sorted(map(str, p.collect())) for p in plans]
        assert rows[0] == rows[1] and rows[0]
    finally:
        spark.conf.set(key, before)
    twice = n.unionByName(n)
    rows = [sorted(map(str, cohort.select_note_texts(twice, words, by_stay=b).collect())) for b in (False, True)]
    assert rows[0] == rows[1]
