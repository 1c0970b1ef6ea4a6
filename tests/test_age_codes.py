import datetime as dt

from pyspark.sql import functions as F

from cohortspark.functions.columns import age_band, age_years
from cohortspark.operators import codes


def test_age_bands(spark):
    visit = dt.datetime(2020, 6, 1)
    ages = [7, 8, 17, 18, 25, 26, 65, 66, 120, 121]
    rows = [(a, dt.date(2020 - a, 5, 1), visit) for a in ages] + [(-1, dt.date(2021, 1, 1), visit), (None, None, visit)]
    df = spark.createDataFrame(rows, "want int, birth_date date, visit_start_date timestamp_ntz")
    out = df.select("want", age_years().alias("age")).withColumn("band", age_band("age")).collect()
    got = {(r.want, r.age, r.band) for r in out}
    assert (7, 7, "Unknown") in got and (8, 8, "8-17") in got and (17, 17, "8-17") in got
    assert (18, 18, "18-25") in got and (65, 65, "26-65") in got and (66, 66, "66-120") in got
    assert (120, 120, "66-120") in got and (121, 121, "Unknown") in got
    assert (-1, -1, "Unknown") in got and (None, None, "Unknown") in got


def test_birth_on_visit_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 6, 1), dt.datetime(2020, 6, 1))], "birth_date date, visit_start_date timestamp_ntz")
    assert df.select(age_years().alias("a")).first().a == 0


def test_code_range_and_rule(spark):
    rows = [
        (1, 1, "DP", "ICD10:S12"), (1, 2, "DAS", "ICD10:X60"),      # rule ok (bound 60)
        (2, 1, "DP", "ICD10:T98"), (2, 2, "DAS", "ICD10:X84"),      # rule ok (bounds)
        (3, 1, "DP", "ICD10:T99"), (3, 2, "DAS", "ICD10:X70"),      # T99 out of range
        (4, 1, "DP", "ICD10:S01"), (4, 2, "DAS", "ICD10:X59"),      # X59 out
        (5, 1, "DP", "ICD10:S01"), (5, 2, "DAS", "ICD10:X85"),      # X85 out
        (6, 1, "DAS", "ICD10:S01"), (6, 2, "DP", "ICD10:X65"),      # swapped types
        (7, 1, "DP", "ICD10:S0A"), (7, 2, "DAS", "ICD10:X6B"),      # non-numeric parts
    ]
    c = spark.createDataFrame(rows, "encounter_num long, instance_num int, diag_type string, concept_cd string")
    got = {r.encounter_num: list(r.number_codes) for r in codes.code_rule(c).collect()}
    assert got == {1: [60], 2: [84]}
    rng = {r.encounter_num for r in codes.code_range(c, "X", 60, 84, "DAS").collect()}
    assert rng == {1, 2, 3}
