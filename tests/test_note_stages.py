"""The chosen notes and their visits as stages: the texts are joined to these only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import cohort
from cohortspark.plans import study
from cohortspark.plans.registry import ROOT_SETTING
from cohortspark.sources import adapters


@pytest.fixture()
def tables(spark, tmp_path):
    day = dt.datetime(1996, 3, 1)
    docs = [(i, f"seen with pain {i}" if i % 4 else "nothing here", "en", f"src{i % 3}", 10) for i in range(60)] + [
        (None, "with no id", "en", "src1", 10), (7, "a copy with another text", "en", "src1", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # stay 3 has two rows, stay 5 none; most stays have no note
    orders = [(k, k % 7, "F", 1.0, day + dt.timedelta(days=k % 90), "1-URGENT") for k in [*range(5), *range(6, 400), 3]] + [(None, 1, "F", 1.0, day, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                                  "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get(ROOT_SETTING, None)
    spark.conf.set(ROOT_SETTING, f"{tmp_path}/stages")
    yield str(tmp_path)
    spark.conf.set(ROOT_SETTING, before) if before else spark.conf.unset(ROOT_SETTING)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_note_stage_is_the_choice_on_whole_notes(spark, tables):
    from cohortspark.operators import text

    words = [cohort.combined_pattern(x) for x in (text.LEXICON, study.RF_LEXICON)]
    plain = cohort.select_note_texts(adapters.notes(spark, tables), words, "keep_last", study.P, by_stay=True)
    staged = study.note_stage(spark, tables).df
    assert staged.columns == plain.columns and _rows(staged) == _rows(plain)
    assert staged.count() > 15


def test_only_the_visits_of_noted_stays_are_joined(spark, tables):
    v = study.visit_stage(spark, tables).df
    assert _rows(v.groupBy("encounter_num").count()) == _rows(spark.createDataFrame(
        [(k, 2 if k == 3 else 1) for k in range(20) if k != 5], "encounter_num long, count long"))
    every = adapters.visits(spark, tables).select("encounter_num", "patient_num", "visit_start_date")
    assert _rows(v) == _rows(every.where(F.col("encounter_num") < 20))


def test_first_letters_in_every_case(spark):
    """A place is looked at in every case of its letters, also those that only Unicode folds."""
    from cohortspark.operators import text

    lexicon = {"six": text.whole_words(["six", "kilo"]), "été": text.whole_words(["été"])}
    words = ["six", "SIX", "ſix", "Sıx", "sİx", "kilo", "Kilo", "KILO", "été", "ÉTÉ", "sixt", "xsix"]
    out = spark.createDataFrame([(" ".join(words),)], "t string").select(text.spans(F.col("t"), lexicon).alias("s")).select(F.explode("s.match"))
    plain = "|".join(p.removeprefix("(?iu)") for p in lexicon.values())
    same = spark.createDataFrame([(" ".join(words),)], "t string").select(F.explode(F.regexp_extract_all("t", F.lit("(?iu)" + plain), F.lit(0))))
    assert [r[0] for r in out.collect()] == [r[0] for r in same.collect()]
    assert out.count() >= 8


def test_marker_characters_of_a_text_stay_no_cuts(spark):
    from cohortspark.operators import text

    t = f"a{text.MARK}b six {text.SEP}{text.SEP}c six"
    got = spark.createDataFrame([(t,), (None,)], "t string").select(F.col("t").isNull().alias("no"), text.spans(F.col("t"), {"six": r"six"}).alias("s"))
    assert [[(s.start, s.end, s.label) for s in r.s or []] for r in got.orderBy("no").collect()] == [[(4, 7, 0), (12, 15, 0)], []]


def test_linked_stage_is_narrow_and_gives_the_same_flags(spark, tables):
    """Words and snippets, most of a mention, are not shuffled by the link with the dates."""
    from cohortspark.operators.stays import flag_mentions, stay_rollup

    spark.createDataFrame([(k,) for k in range(7)], "c_custkey long").write.parquet(f"{tables}/customer.parquet")
    staged, whole = study.link_stage(spark, tables).df, study.linked_mentions(spark, tables)
    assert not {"words", "snippet", "section", "lexical_variant"} & set(staged.columns)
    assert {"words", "snippet", "date_dt"} <= set(whole.columns)
    cols = ["note_id", "encounter_num", "start_char", "end_char", "std_lexical_variant", "instance_flag", "history_flag"]
    assert _rows(flag_mentions(staged).select(*cols)) == _rows(flag_mentions(whole).select(*cols))
    assert _rows(study.text_stays(spark, tables)) == _rows(stay_rollup(flag_mentions(whole), study.P))
    assert staged.count() > 15
