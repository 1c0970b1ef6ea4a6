"""Corpus pipeline over ``documents``: each stage calls one operator of ``cohortspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's input. All but the last return the columns of ``documents``;
the last returns the packed pieces.

Defined results: null columns, empty and very long texts, ties, repeated rows, empty tables and
extra columns pass as the operators define. Decisions are made for rows, told apart by doc_id and a hash of
the text: a rejected row goes even if its doc_id is null, and takes no namesake along; rows equal in doc_id
and text are decided alike, and the SimHash stage keeps one of them. A row with a null doc_id is in no group
of near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import row_key, stage, table
from cohortspark.llm.decontaminate import decontaminate
from cohortspark.llm.langid import identify
from cohortspark.llm.lines import dedup_lines
from cohortspark.llm.packing import best_fit_packing
from cohortspark.llm.simhash import simhash_classes


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows (doc_id, row)."""
    gone = rows.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    x = docs.withColumn("_key", row_key())
    return x.join(gone, x.doc_id.cast("long").eqNullSafe(gone["_id"]) & (x["_key"] == gone["_row"]), "left_anti").select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that are equal in doc_id and text; only such rows are shuffled."""
    x = docs.withColumn("_key", row_key())
    many = x.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_row")).agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1")
    many = stage(many.select("_id", "_row"), "repeated")
    same = x.doc_id.eqNullSafe(many["_id"]) & (x["_key"] == many["_row"])
    alone = x.join(many, same, "left_anti")
    return alone.unionByName(x.join(many, same, "left_semi").dropDuplicates(["doc_id", "_key"])).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (null text or no letter) or an ambiguous one go."""
    found = identify(docs, with_row=True)
    return _without(docs, found.where("lang_pred = 'und' or ambiguous"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut from the texts; a document left without any compared line and without
    a shorter line of its own goes."""
    return dedup_lines(docs).withColumn(
        "n_chars", F.when(F.col("dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the smallest id of each class stays, once."""
    classes = simhash_classes(docs, k=3, max_bits=3)
    gone = classes.where("component_id <> doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    return _once(docs).join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), with_row=True).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in sequences of at most 2048."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: the stages use fingerprints, tokenizers and trained models, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each read back from its written table."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return docs
