import os

from pyspark.sql import functions as F

from cohortspark.plans.registry import Registry, files_digest, plan_digest


def test_stages_are_reused_and_follow_their_inputs(spark, tmp_path):
    src, root = str(tmp_path / "in.parquet"), str(tmp_path / "stages")
    spark.range(10).write.parquet(src)
    made = []

    def stage(expr="id * 2 AS x", params=None):
        s = Registry(spark, root).stage("t", lambda: spark.read.parquet(src).selectExpr(expr), [src], params=(expr, params))
        made.append(s.digest)
        return sorted(r[0] for r in s.df.collect())

    assert stage() == [2 * i for i in range(10)] and stage() == [2 * i for i in range(10)]
    assert made[0] == made[1] and len([x for x in os.listdir(root)]) == 1
    folder = os.path.join(root, f"t-{made[0]}")
    assert len([x for x in os.listdir(folder) if len(x) == 32]) == 1        # written once
    assert stage("id * 3 AS x") == [3 * i for i in range(10)] and made[2] != made[0]
    stage(params="p")
    assert made[3] != made[0]
    spark.range(5).write.mode("overwrite").parquet(src)                    # a changed file gives a new stage
    assert stage() == [0, 2, 4, 6, 8] and made[4] != made[0]


def test_half_written_stage_is_ignored(spark, tmp_path):
    src, root = str(tmp_path / "in.parquet"), str(tmp_path / "stages")
    spark.range(4).write.parquet(src)
    build = lambda: spark.read.parquet(src)
    r = Registry(spark, root)
    place = f"{root}/t-{r.address('t', build, [src])}"
    spark.range(1).write.parquet(f"{place}/{'0' * 32}")                     # no marker names it
    assert r.stage("t", build, [src]).df.count() == 4
    assert r.stage("t", build, [src]).df.count() == 4


def test_plan_digest_ignores_running_numbers(spark):
    from pyspark.sql import functions as F

    make = lambda k: spark.range(3).select(F.transform(F.array("id"), lambda x: x + k).alias("a"))
    assert plan_digest(make(1)) == plan_digest(make(1)) != plan_digest(make(2))
    d = "/root/testdata/sf0.001"
    assert files_digest(spark, [f"{d}/orders.parquet"]) != files_digest(spark, [f"{d}/customer.parquet"])


def test_risk_ratio_reads_documents_once(spark, tmp_path):
    """The staged notes are the only read; the query itself reads stage tables."""
    from cohortspark.plans import queries as Q
    from cohortspark.plans.registry import ROOT_SETTING

    spark.conf.set(ROOT_SETTING, str(tmp_path / "s"))
    try:
        df = Q.QUERIES["risk_ratio"](spark, "/root/testdata/sf0.001")
        files = df.inputFiles()
        assert not any("documents.parquet" in f for f in files)
        assert len([x for x in os.listdir(tmp_path / "s") if x.startswith("notes-")]) == 1
    finally:
        spark.conf.unset(ROOT_SETTING)


def test_model_is_saved_once_and_feeds_the_stays(spark, tmp_path):
    from cohortspark.plans import study
    from cohortspark.plans.registry import ROOT_SETTING

    d = "/root/testdata/sf0.001"
    spark.conf.set(ROOT_SETTING, str(tmp_path / "s"))
    try:
        a, b = study.mention_model(spark, d), study.mention_model(spark, d)
        assert a == b
        scores = study.model_scores(spark, d)
        assert scores.digest == study.model_scores(spark, d).digest
        positive = scores.df.where("prediction").count()
        flagged = study.flagged_mentions(spark, d, "model")
        assert flagged.where("instance_flag").count() == positive
        assert study.stays_by_source(spark, d, "model").where("positive_visit").count() == study.text_stays(spark, d, "model").where("nlp_positive").count()
    finally:
        spark.conf.unset(ROOT_SETTING)


def test_one_file_of_a_stage_is_read_by_many_tasks(spark, tmp_path):
    """A stage written by one task has row groups of some MB, so that the next step's tasks do not follow its input."""
    import pyarrow.parquet as pq

    words = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(s)), 512) for s in "abc"])
    df = spark.range(0, 100_000, 1, 1).select("id", words.alias("t"))
    staged = Registry(spark, str(tmp_path / "s")).stage("big", lambda: df, [])
    files = [f.removeprefix("file://") for f in staged.df.inputFiles()]
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in files]
    assert len(files) == 1 and groups[0] > 3
    assert staged.df.agg(F.count("t"), F.sum("id")).first()[:] == (100_000, 100_000 * 99_999 // 2)
