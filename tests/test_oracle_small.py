"""A representative subset of the DuckDB oracle comparison, inside the test suite (sf0.001)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
NAMES = ["monthly_incidence", "episodes", "keep_last", "code_rule", "attrition", "mentions", "stay_rollup",
         "incidence_grouping_sets", "its_coefficients", "risk_ratio", "km_curve", "logrank_p", "asof_nearest",
         "cohen_kappa", "stratified_sample", "modality_mix"]


@pytest.fixture(scope="module")
def con():
    from cohortspark.sources.tables import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from check_oracle import digest

    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns)[0] == digest(drows, dcols)[0]


def test_time_zone_independent(spark):
    import __spark_entry__ as E

    q = E.queries()
    before = {n: sorted(map(tuple, q[n](spark, SF).collect()), key=repr) for n in ("episodes", "asof_nearest", "km_input")}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = {n: sorted(map(tuple, q[n](spark, SF).collect()), key=repr) for n in before}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after
