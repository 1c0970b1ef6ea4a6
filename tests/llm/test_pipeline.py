import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm.common import stage

from helpers import docs_frame

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = [(8001, None), (8002, ""), (8003, "123 !!"), (8004, first["text"]), (8005, bench), (None, "words without an id but long enough to count"),
           (8006, "une phrase de plus pour la fin du corpus qui est en cours\n" * 3)]
    frame = docs.unionByName(docs_frame(spark, odd, extra=False))
    seen, x = {}, frame
    for name, step in corpus_pipeline.STAGES:
        x = stage(step(spark, x, SF), "test")
        seen[name] = x
        if name != "best-fit packing":
            assert x.columns == docs.columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in seen.items()}
    assert not ids["language ID"] & {8001, 8002, 8003} and {8004, 8005, 8006, None} <= ids["language ID"]
    assert 8004 not in ids["line dedup"] and first["doc_id"] in ids["line dedup"]
    text = {r["doc_id"]: r["text"] for r in seen["line dedup"].collect()}
    assert text[8006].strip() == "une phrase de plus pour la fin du corpus qui est en cours"
    assert 8005 not in ids["benchmark decontamination"]
    assert ids["best-fit packing"] == ids["benchmark decontamination"]


def test_decisions_are_for_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60).collect()
    clean = some[0]["text"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = [(None, "12 !!"), (9001, "34 !!"), (9001, clean + " own end"), (None, bench), (9002, bench), (9002, clean + " other end"),
           (9003, "twice the very same row in this table of documents"), (9003, "twice the very same row in this table of documents")]
    frame = docs.unionByName(docs_frame(spark, odd, extra=False))
    rows = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.where("doc_id > 9000 or doc_id is null").collect())
    assert rows(corpus_pipeline.language_id(spark, frame, SF)) == sorted((i or 0, t) for i, t in odd if "!!" not in t)
    assert rows(corpus_pipeline.decontamination(spark, frame, SF)) == sorted((i or 0, t) for i, t in odd if t != bench)
    near = rows(corpus_pipeline.near_dedup(spark, frame, SF))
    assert near.count((9003, odd[-1][1])) == 1


def test_empty_documents(spark):
    x = docs_frame(spark, [], extra=False)
    for _, step in corpus_pipeline.STAGES:
        x = stage(step(spark, x, SF), "test")
        assert x.count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Workers whose path lacks the package run the operators that ship objects of its classes."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from cohortspark.session import build_session
from cohortspark.llm.decontaminate import decontaminate
from cohortspark.llm.langid import identify
from cohortspark.llm.mixing import mixing_scores
spark = build_session("local[2]", 2)
def lost(_):
    try:
        import cohortspark
        return [1]
    except ImportError:
        return [0]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lost).collect() == [0]
docs = spark.read.parquet({SF!r} + "/documents.parquet").where("doc_id < 40")
bench = spark.read.parquet({SF!r} + "/benchmark.parquet")
print(decontaminate(docs, bench).count(), identify(docs).count(), mixing_scores(docs).where("score < 0").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    n = out.stdout.split()[-3:]
    assert n[0] == n[1] and int(n[2]) > 0


def test_entry_registers_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", ["op1_cap_near_dedup", "op4_benchmark_decontamination"])
def test_queries_match_sql(spark, name):
    import duckdb

    from cohortspark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    cols = [c[0] for c in res.description]
    assert sorted(tuple(r) for r in got.select(*[F.col(c) for c in cols]).collect()) == sorted(res.fetchall())
