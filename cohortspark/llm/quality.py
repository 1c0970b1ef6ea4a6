"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are counted per document. A random forest is fitted on labelled rows; every path from
its roots is a conjunctive rule. A lasso logistic regression over the rules' 0/1 columns keeps few
of them, and the kept rules with their weights are compiled into one Spark column expression.

The fit uses at most ``max_rows`` labelled rows, those with the smallest hash of doc_id; scores
are computed for all documents. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null text counts as empty and gets a score like any other; null quality labels
are not learned; without labelled rows of both classes the score is the learned share of label 1
(0.5 without any); a null doc_id is never held out and keeps its row; repeated rows each get a
row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import arrow_map, binary_texts, crc_fold, stage

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_MARKS, _SYMBOLS = b".,;:'\"()-", b"!#$%&*+/<=>?@[\\]^_`{|}~"

STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "shouts", "pipes", "distinct",
              "top_word", "repeats", "log_lines", "line_words", "same_lines", "longest_word", "ends", "capitals")


def statistics(text: bytes) -> tuple[float, ...]:
    """Statistics of one text; shares are of its bytes, words or lines."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(w.lower() for w in words)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    return (
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / m, share(_UPPER), share(_DIGITS), share(_MARKS),
        share(_SYMBOLS), text.count(b"!!") / m, text.count(b"|") / m, len(counts) / m, max(counts.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, math.log1p(len(lines)), m / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(max(map(len, words), default=0)),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        sum(65 <= w[0] <= 90 for w in words) / m,
    )


def _rules(forest) -> list[tuple]:
    """The distinct conjunctions of the trees' paths: ((statistic, upper side, threshold), ...)."""
    found: dict[tuple, None] = {}

    def walk(node, path: dict) -> None:
        if path:
            found[tuple(sorted((f, side, t) for (f, side), t in path.items()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            f, t = node.split().featureIndex(), node.split().threshold()
            walk(node.leftChild(), path | {(f, False): min(t, path.get((f, False), math.inf))})
            walk(node.rightChild(), path | {(f, True): max(t, path.get((f, True), -math.inf))})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), {})
    return list(found)


def _condition(rule: tuple, names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(names[f]) > t if upper else F.col(names[f]) <= t for f, upper, t in rule])


def fit_rules(stats: DataFrame, label: str, trees: int = 12, depth: int = 4, lasso: float = 0.002, seed: int = 11):
    """(intercept, [(rule, weight)]) of the sparse rule ensemble over ``STATISTICS``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    share = stats.agg(F.avg(label).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not share["n"] or share["p"] in (0.0, 1.0):
        p = min(max(share["p"] if share["n"] else 0.5, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p)), []
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(stats)
    forest = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed,
                                    minInstancesPerNode=5).fit(rows)
    rules = _rules(forest)
    if not rules:
        return math.log(share["p"] / (1 - share["p"])), []
    flags = F.array(*[_condition(r, STATISTICS).cast("double") for r in rules])
    from pyspark.ml.functions import array_to_vector

    x = stats.select(F.col(label).cast("double").alias(label), array_to_vector(flags).alias("_r"))
    model = LogisticRegression(featuresCol="_r", labelCol=label, regParam=lasso, elasticNetParam=1.0, standardization=False,
                               maxIter=60).fit(x)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6]
    return float(model.intercept), kept


def compile_rules(intercept: float, kept: list[tuple]) -> Column:
    """The ensemble as one column: the logistic of the intercept and the weights of the rules that hold."""
    total = reduce(lambda a, b: a + b, [F.when(_condition(r, STATISTICS), w).otherwise(0.0) for r, w in kept], F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod 4 is 2
    are held out of the fit."""

    def run(batch: pa.RecordBatch) -> dict:
        got = [statistics(t) for t in binary_texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id")} | dict(zip(STATISTICS, zip(*got)))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stats = stage(arrow_map(src, run, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)), "stats")
    held = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double"))
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = known.where(~held).orderBy(order, "doc_id", "quality").limit(max_rows)
    intercept, kept = fit_rules(stage(stats.join(chosen, "doc_id"), "labelled"), "quality")
    return stats.select("doc_id", held.alias("held_out"), compile_rules(intercept, kept).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
