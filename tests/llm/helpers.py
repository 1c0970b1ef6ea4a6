"""Small inputs shared by the tests of the training-data operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=True):
    """documents rows (doc_id, text[, lang]) with the other columns, and columns with clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        for c in ("id", "fp", "bucket", "component", "row", "digest", "key", "n", "held_out", "class", "a", "b"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
    return df


def texts(n, seed, words=("al", "be", "ga", "de", "ep", "ze"), length=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, length)))
            for _ in range(n)]


def classes(n, links):
    """Smallest reachable index of each of n nodes."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]
