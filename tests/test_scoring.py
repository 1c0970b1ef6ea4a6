import sys

from pyspark.sql import functions as F


def _make_predict_fn():
    import numpy as np

    def predict(x: "np.ndarray") -> "np.ndarray":
        return x.sum(axis=1).astype("float32")   # number of tokens in the window

    return predict


def test_batch_model_scores_every_mention(spark):
    from pyspark import cloudpickle

    from cohortspark.operators.scoring import score_with_batch_model

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(1, 0, ["a", "b", "with", "c"]), (1, 9, ["with"]), (2, 3, [])]
    m = spark.createDataFrame(rows, "note_id long, start_char int, words array<string>")
    got = {(r.note_id, r.start_char): r.ml_score for r in score_with_batch_model(m, _make_predict_fn, 256).collect()}
    assert got == {(1, 0): 4.0, (1, 9): 1.0, (2, 3): 0.0}


def test_pipeline_model_predicts(spark):
    from cohortspark.operators.scoring import score_mentions, train_mention_model

    rows = [(i, ["bad", "pain"] if i % 2 else ["fine", "ok"], bool(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "note_id long, words array<string>, label boolean")
    model = train_mention_model(df, max_iter=30)
    out = {r.note_id: r.ml_prediction for r in score_mentions(model, df.drop("label")).collect()}
    assert all(out[i] == bool(i % 2) for i in range(40))
