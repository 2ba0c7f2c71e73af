"""Text classifiers, cross-validation and batch scoring.

The reference fine-tunes a transformer per fold on one GPU.  Here training
is a Spark ML pipeline (hashed term frequencies, IDF, logistic regression),
fitted per fold on the executors; folds come from the stratified assignment
(W2) and the metrics are the plain SQL aggregations of ``metrics``.  Any
user Python model can still score a column in Arrow batches of 100 texts
through ``predict_batch_udf`` (loaded once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.operators.metrics import classification_metrics, stratified_folds
from textlab.operators.stats import drop_null_labels
from textlab.session import cut_lineage

NUM_FEATURES = 1 << 16


def text_pipeline(tokens: str = "toks", label: str = "label", binary: bool = False,
                  num_features: int = NUM_FEATURES, reg: float = 0.01, max_iter: int = 30) -> Pipeline:
    """M5/M6: hashed TF -> IDF -> logistic regression (multinomial or binomial)."""
    return Pipeline(stages=[
        HashingTF(inputCol=tokens, outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, predictionCol="prediction",
                           family="binomial" if binary else "multinomial",
                           regParam=reg, maxIter=max_iter),
    ])


def _fit(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit and drop the logistic model's training summary (a copy of the
    stage carries none): the summary holds the session, which cannot be
    serialised into the prediction closure once the session has used an
    ``Observation``."""
    model = pipeline.fit(df)
    jvm = df.sparkSession._jvm
    for st in model.stages:
        java = getattr(st, "_java_obj", None)
        if java is not None and hasattr(st, "hasSummary") and st.hasSummary:
            java.setSummary(jvm.scala.Option.apply(None))
    return model


def cross_validate(df: DataFrame, id_col: str, label: str, k: int, pipeline: Pipeline,
                   seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M7: stratified k-fold fits.  Returns ``(predictions, per_fold)`` where
    predictions is (fold, id, label, prediction) for every row (each row
    predicted by the model that did not see it) and per_fold has n, accuracy
    and weighted F1 per fold.  Rows without a label are dropped first (P5)."""
    folded = cut_lineage(stratified_folds(drop_null_labels(df, label), label, id_col, k, seed))
    parts = []
    for f in range(k):
        model = _fit(pipeline, folded.where(F.col("fold") != f))
        pred = model.transform(folded.where(F.col("fold") == f))
        parts.append(pred.select("fold", id_col, label, F.col("prediction").cast("int").alias("prediction")))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    per_fold = classification_metrics(preds, label, "prediction", by=["fold"])
    return preds, per_fold


def fit_all(df: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """The model to keep is refitted on all rows (the reference kept the last
    fold's model)."""
    return _fit(pipeline, df)


def save_model(model: PipelineModel, path: str) -> None:
    """S7."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S7."""
    return PipelineModel.load(path)


def batch_scorer(make_predict_fn: Callable, return_type: T.DataType, batch_size: int = 100):
    """M4 for any Python model: ``make_predict_fn()`` runs once per Python
    worker and returns ``predict(texts: np.ndarray) -> dict[str, np.ndarray]``
    (for a struct return type); rows reach it in Arrow batches of
    ``batch_size``."""
    return predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)


SCORE_TYPE = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


def lexicon_model_factory(lexicon: dict, alpha: float = 15.0):
    """A small stand-in for a pretrained sentiment model: a Python callable
    over a batch of texts returning POSITIVE/NEGATIVE with a confidence.  Used
    to exercise the batch-scoring path; real models plug in the same way."""
    import re

    lex = dict(lexicon)

    def make():
        pat = re.compile(r"[^\W\d_]+")

        def predict(texts: np.ndarray):
            labels, scores = [], []
            for t in texts:
                s = sum(lex.get(w, 0.0) for w in pat.findall(str(t).lower()))
                comp = round(s / (s * s + alpha) ** 0.5, 9) + 0.0  # sums that cancel are 0 in any order
                labels.append("POSITIVE" if comp >= 0 else "NEGATIVE")
                scores.append(abs(comp))
            return {"label": np.array(labels, dtype=object), "score": np.array(scores, dtype=float)}
        return predict
    return make
