import os


def test_text_study_stages_match_direct_queries(spark):
    from cohortspark.plans import queries as Q
    from cohortspark.plans.stages import run_text_study

    d = "/root/testdata/sf0.001"
    out = run_text_study(spark, d, run_id="test-run")
    root = out["root"]
    assert root.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    for name in ("selected_notes", "mentions", "stays"):
        assert os.path.isdir(os.path.join(root, name))
    direct = Q.study.flagged_mentions(spark, d).select("note_id", "start_char", "instance_flag").collect()
    staged = out["mentions"].select("note_id", "start_char", "instance_flag").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, staged))
    text_src = Q.study.stays_by_source(spark, d, "text").select("encounter_num", "positive_visit", "recurrent_visit")
    assert sorted(map(tuple, text_src.collect())) == sorted(
        map(tuple, out["stays"].select("encounter_num", "positive_visit", "recurrent_visit").collect()))
    assert out["monthly"].count() > 0 and out["its"].count() == 2 * 15
