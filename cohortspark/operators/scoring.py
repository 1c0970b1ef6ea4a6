"""Mention scoring (X13) and the training set build.

The surveyed study scores mentions with a fine-tuned transformer on GPUs; that model is not part
of this repository. Re-aimed: a distributed ``pyspark.ml`` pipeline on each mention's token
window (hashed term counts + logistic regression), trained on annotated mentions and applied
to all mentions as a Spark transform. Any other model plugs in with ``predict_batch_udf``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: what a trained model depends on besides its rows
SETTINGS = {"num_features": 1 << 16, "max_iter": 20, "reg_param": 0.01}


def train_mention_model(labelled: DataFrame, words: str = "words", label: str = "label",
                        num_features: int = SETTINGS["num_features"], max_iter: int = SETTINGS["max_iter"]) -> PipelineModel:
    """Fit hashed token-window features + logistic regression (distributed gradient)."""
    data = labelled.select(F.transform(F.col(words), lambda w: F.lower(w)).alias("_w"), F.col(label).cast("double").alias("label"))
    pipe = Pipeline(stages=[
        HashingTF(inputCol="_w", outputCol="features", numFeatures=num_features),
        LogisticRegression(maxIter=max_iter, regParam=SETTINGS["reg_param"], featuresCol="features", labelCol="label"),
    ])
    return pipe.fit(data)


def load_mention_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_mentions(model: PipelineModel, mentions: DataFrame, words: str = "words") -> DataFrame:
    """Boolean prediction and probability per mention, keyed like the mentions."""
    x = mentions.withColumn("_w", F.transform(F.col(words), lambda w: F.lower(w)))
    out = model.transform(x)
    from pyspark.ml.functions import vector_to_array

    prob = F.element_at(vector_to_array(F.col("probability")), 2)
    return out.select(*mentions.columns, (F.col("prediction") > 0.5).alias("ml_prediction"),
                      prob.alias("ml_probability"))


def training_split(rounds: DataFrame, patients_of: DataFrame, validation_round: str,
                   order: list[str], key: list[str] = ("note_id",)) -> DataFrame:
    """Drop unclear rows, dedup by key in the annotator preference order, and send the
    patients seen in ``validation_round`` to validation (semi join on patient)."""
    key = list(key)
    r = rounds.where(F.coalesce(F.col("remark"), F.lit("")) != "unclear")
    rank = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("annotator"))
    cols = [c for c in r.columns if c not in key]
    first = r.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(rank, F.col("annotator"), F.col("round"))).alias("x"))
    first = first.select(*key, "x.*").join(patients_of, "note_id", "left")
    val_patients = r.where(F.col("round") == validation_round).join(patients_of, "note_id").select("patient_num").distinct()
    val = first.join(val_patients, "patient_num", "left_semi").withColumn("split", F.lit("validation"))
    train = first.join(val_patients, "patient_num", "left_anti").withColumn("split", F.lit("train"))
    return val.unionByName(train)



def score_with_batch_model(mentions: DataFrame, make_predict_fn, num_features: int = 1 << 12,
                           words: str = "words", batch_size: int = 512) -> DataFrame:
    """X13, pluggable model: hashed token-window features as dense float arrays, scored in
    Arrow batches by ``predict_batch_udf``. ``make_predict_fn`` runs once per Python worker
    and returns ``f(np.ndarray[batch, num_features]) -> np.ndarray[batch]`` (for example an
    ONNX session's run). Adds ``ml_score``."""
    from pyspark.ml.functions import predict_batch_udf, vector_to_array
    from pyspark.sql.types import FloatType

    x = mentions.withColumn("_w", F.transform(F.col(words), lambda w: F.lower(w)))
    x = HashingTF(inputCol="_w", outputCol="_f", numFeatures=num_features).transform(x)
    x = x.withColumn("_a", vector_to_array(F.col("_f"), "float32"))
    udf = predict_batch_udf(make_predict_fn, return_type=FloatType(), batch_size=batch_size,
                            input_tensor_shapes=[[num_features]])
    return x.withColumn("ml_score", udf("_a")).drop("_w", "_f", "_a")
