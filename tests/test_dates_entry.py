import datetime as dt

from pyspark.sql import functions as F

from cohortspark.operators import dates


def test_date_families_and_cleaning(spark):
    t = "Seen 12/03/2019 and 2019-02-30, il y a 3 jours; 2 months ago; pendant 5 jours. 31/12/1960"
    notes = spark.createDataFrame([(1, 7, t)], "note_id long, encounter_num long, note_text string")
    dm = dates.date_mentions(notes, keep_cols=("encounter_num",))
    rows = {r.match: r for r in dm.collect()}
    assert rows["12/03/2019"].date_dt == dt.date(2019, 3, 12)
    assert rows["2019-02-30"].date_dt is None               # not a calendar date
    assert rows["il y a 3 jours"].label == "relative" and rows["il y a 3 jours"].value == 3
    assert rows["pendant 5 jours"].label == "duration"
    assert rows["12/03/2019"].start_char == t.find("12/03/2019")
    ref = dm.withColumn("visit_start_date", F.lit(dt.datetime(2020, 5, 10)))
    res = {r.match: r.date_dt for r in dates.resolve_relative(ref).collect()}
    assert res["il y a 3 jours"] == dt.date(2020, 5, 7) and res["2 months ago"] == dt.date(2020, 3, 10)
    clean = dates.clean_dates(dates.resolve_relative(ref).withColumn("birth_date", F.lit(dt.date(1960, 12, 31))))
    c = {r.match: r.is_birth_date for r in clean.collect()}
    assert "pendant 5 jours" not in c and "2019-02-30" not in c and c["31/12/1960"] is True


def test_history_by_date(spark):
    from cohortspark.params import StudyParams

    rows = [(1, dt.date(2020, 1, 1), dt.datetime(2020, 1, 16), False, None),      # exactly 15 days -> history
            (2, dt.date(2020, 1, 2), dt.datetime(2020, 1, 16), False, None),      # 14 days -> not
            (3, dt.date(2019, 1, 1), dt.datetime(2020, 1, 16), True, None),       # birth date -> not
            (4, None, dt.datetime(2020, 1, 16), False, True)]                      # no date keeps qualifier
    df = spark.createDataFrame(rows, "id long, date_dt date, visit_start_date timestamp_ntz, is_birth_date boolean, history boolean")
    got = {r.id: r.history for r in dates.history_by_date(df, StudyParams()).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns[:3] == ["sex_cd", "age_cat", "date"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_units_names_partial_dates_and_directions(spark):
    t = "Vu il y a 3 mois, puis 3 mars 2019, en Août 2018 et depuis 2017. Revu dans 2 semaines, back in 1 year. Code 20191 et x2019."
    notes = spark.createDataFrame([(1, t)], "note_id long, note_text string")
    dm = dates.date_mentions(notes)
    ref = dm.withColumn("visit_start_date", F.lit(dt.datetime(2020, 5, 31)))
    got = {r.match: r for r in dates.resolve_relative(ref).collect()}
    assert set(got) == {"il y a 3 mois", "3 mars 2019", "Août 2018", "2017", "dans 2 semaines", "in 1 year"}
    assert got["il y a 3 mois"].date_dt == dt.date(2020, 2, 29) and got["il y a 3 mois"].direction == "past"
    assert got["3 mars 2019"].date_dt == dt.date(2019, 3, 3)
    assert got["Août 2018"].date_dt == dt.date(2018, 8, 1) and got["Août 2018"].day is None
    assert got["2017"].date_dt == dt.date(2017, 1, 1) and got["2017"].month is None
    assert got["dans 2 semaines"].date_dt == dt.date(2020, 6, 14) and got["dans 2 semaines"].direction == "future"
    assert got["in 1 year"].date_dt == dt.date(2021, 5, 31)
    assert got["il y a 3 mois"].sent_id == 0 and got["dans 2 semaines"].sent_id == 1
    assert got["il y a 3 mois"].start == 1 and got["2017"].start == 17


def test_one_matcher_resolves_conflicts_and_completes_parts(spark):
    t = ("il y a 2010 jours; 03.04.2019; March 3, 2019; 3/4/19; 3/4/70, hier, avant-hier, aujourd’hui, demain. le 5 juin et June 7th. "
         "2010 jours; 12 mars 3; 2019/02/03; il y a 999999999 ans; il y a 99999999 semaines; il y a 99999999999999 ans; 99 mars 2019; 29 février 2019")
    notes = spark.createDataFrame([(1, t)], "note_id long, note_text string")
    ref = dates.date_mentions(notes).withColumn("visit_start_date", F.lit(dt.datetime(2020, 5, 31)))
    rows = dates.resolve_relative(ref).orderBy("start_char").collect()
    got = {r.match: r.date_dt for r in rows}
    d = dt.date
    assert got == {
        "il y a 2010 jours": d(2020, 5, 31) - dt.timedelta(2010), "03.04.2019": d(2019, 4, 3), "March 3, 2019": d(2019, 3, 3),
        "3/4/19": d(2019, 4, 3), "3/4/70": d(1970, 4, 3), "hier": d(2020, 5, 30), "avant-hier": d(2020, 5, 29), "aujourd’hui": d(2020, 5, 31),
        "demain": d(2020, 6, 1), "5 juin": d(2020, 6, 5), "June 7th": d(2020, 6, 7), "12 mars": d(2020, 3, 12), "2019/02/03": d(2019, 2, 3),
        "il y a 999999999 ans": None, "il y a 99999999 semaines": None, "il y a 99999999999999 ans": None, "99 mars 2019": None,
        "29 février 2019": None}
    assert [r.match for r in rows if r.label == "relative"][:1] == ["il y a 2010 jours"]
    assert all(t[r.start_char:r.end_char] == r.match for r in rows)
    empty = spark.createDataFrame([], "note_id long, note_text string")
    assert dates.date_mentions(empty).collect() == []
