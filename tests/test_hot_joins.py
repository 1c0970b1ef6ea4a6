from pyspark.sql import functions as F

from cohortspark.operators import cohort, its
from cohortspark.operators.joins import SALTS, hot_join, hot_keys
from cohortspark.operators.stays import add_weights
from cohortspark.params import StudyParams


def _rows(spark, n=60_000):
    """A third of the rows on one key, some keys null, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(1000 + F.col("id") % 5000)
    return spark.range(n).select(F.col("id"), key.cast("long").alias("k"))


def test_hot_key_is_dealt_over_many_tasks_and_nothing_changes(spark):
    many = _rows(spark)
    small = many.where("k is not null and k % 7 < 6").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(small, "k", how).select("k", "id", "n").collect()))
        assert sorted(map(str, hot_join(many, small, ["k"], "id", how).select("k", "id", "n").collect())) == want
    hot = hot_keys(many.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k is not null"), ["k"], "n")
    assert [r.k for r in hot.collect()] == [7]
    # the rows that the join deals out, by key and salt: the largest group is below a tenth
    dealt = many.where("k is not null").withColumn("s", F.when(F.col("k") == 7, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    sizes = dealt.groupBy("k", "s").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 0.1 * sizes[1]


def test_counts_and_weights_with_a_hot_stay(spark):
    notes = _rows(spark, 6000).where("k is not null").select(F.col("k").alias("encounter_num"), F.col("id").alias("note_id"))
    got = {(r.encounter_num, r.n_docs_per_visit) for r in cohort.notes_per_stay(notes).collect()}
    assert got == {(r.encounter_num, r["count"]) for r in notes.groupBy("encounter_num").count().collect()}
    assert cohort.notes_per_stay(notes).count() == notes.count()
    stays = notes.select(F.col("note_id").alias("encounter_num"), F.lit("1996-01-01").cast("date").alias("date"),
                         F.when(F.col("encounter_num") == 7, "A").when(F.col("encounter_num") % 2 == 0, "B").otherwise("C").alias("site_label"))
    w = spark.createDataFrame([("1996-01-01", "A", 2.0), ("1996-01-01", "B", 3.0)], "date string, site_label string, stay_weight double").withColumn("date", F.col("date").cast("date"))
    x = add_weights(stays, w)
    assert x.count() == stays.count()
    assert {(r.site_label, r.stay_weight) for r in x.select("site_label", "stay_weight").distinct().collect()} == {("A", 2.0), ("B", 3.0), ("C", None)}


def test_one_fit_of_all_groupings_equals_the_fits_apart(spark):
    p = StudyParams()
    months = F.expr("add_months(date'1995-01-01', cast(id % 79 as int))")
    stays = spark.range(4000).select(months.alias("date"), F.when(F.col("id") % 3 == 0, "M").otherwise("W").alias("sex_cd"),
                                     F.when(F.col("id") % 5 == 0, "8-17").otherwise("18-25").alias("age_cat"), (F.col("id") % 90).alias("age"))
    sets = {"all": [], "sex": ["sex_cd"], "both": ["sex_cd", "age_cat"]}
    got = {(r.grouping, r.sex_cd, r.age_cat): r for r in its.fit_sets(stays, sets, p).collect()}
    assert len(got) == 1 + 2 + 4
    for name, keys in sets.items():
        monthly = stays.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n_sa"))
        for r in its.coefficients(its.design(monthly, keys, p), keys, p).where("term = 'delta_t'").collect():
            g = got[name, r.sex_cd if "sex_cd" in keys else "all", r.age_cat if "age_cat" in keys else "all"]
            assert abs(g.delta_t - r.estimate) < 1e-9 and abs(g.delta_t_upper - r.upper) < 1e-9
    assert got["all", "all", "all"].n_stays == 4000 and abs(sum(r.share for k, r in got.items() if k[0] == "both") - 1) < 1e-12
