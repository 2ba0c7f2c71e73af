"""Fitted models: cross-validation, saved-model scoring, PCA, batch scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.functions.wordlists import LEXICON
from textlab.operators import classify as K
from textlab.operators import clustering as CL


def labelled(spark, n=60):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice(["up", "good", "sun"] if i % 2 else ["down", "bad", "rain"]) for _ in range(8)], i % 2) for i in range(n)]
    rows += [(1000 + i, ["up"], None) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, toks array<string>, label int")


def test_cross_validation_predicts_every_labelled_row_once(spark):
    preds, per_fold = K.cross_validate(labelled(spark), "doc_id", "label", 3, K.text_pipeline("toks", "label", binary=True, num_features=256))
    rows = preds.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(60))      # rows without a label are dropped
    assert all(r["prediction"] == r["label"] for r in rows)
    folds = {r["fold"]: r for r in per_fold.collect()}
    assert set(folds) == {0, 1, 2} and all(f["n"] == 20 and f["accuracy"] == 1.0 for f in folds.values())


def test_two_saved_models_in_a_row(spark, tmpdir_path):
    df = labelled(spark).where("label is not null")
    model = K.fit_all(df, K.text_pipeline("toks", "label", binary=True, num_features=256))
    for name in ("first", "second"):
        K.save_model(model, f"{tmpdir_path}/{name}")
    once = K.load_model(f"{tmpdir_path}/first").transform(df).select("doc_id", "toks", "label", F.col("prediction").alias("one"))
    both = K.load_model(f"{tmpdir_path}/second").transform(once).select("doc_id", "label", "one", "prediction").collect()
    assert len(both) == 60 and all(r["one"] == r["prediction"] == r["label"] for r in both)


def test_pca_keeps_the_distances_of_a_plane(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = {r["id"]: r["reduced"] for r in CL.reduce_dimensions(df, "v", 2).collect()}
    y = np.array([got[i] for i in range(40)])
    dist = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    assert np.allclose(dist(x), dist(y))


def test_batch_scorer_equals_the_python_model(spark):
    texts = ["good good bad", "nothing", "Awful, terrible!", "", "love it"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    scorer = K.batch_scorer(K.lexicon_model_factory(LEXICON), K.SCORE_TYPE, batch_size=2)
    got = [tuple(r["r"]) for r in df.select(scorer("t").alias("r")).collect()]
    want = K.lexicon_model_factory(LEXICON)()(np.array(texts, dtype=object))
    assert [g[0] for g in got] == list(want["label"]) and [g[1] for g in got] == pytest.approx(list(want["score"]))


def test_saved_models_read_tokens_that_are_written_once(spark, tmpdir_path, monkeypatch):
    from textlab.plans import models as M
    words = ["up good sun", "down bad rain", "so so then"]
    spark.createDataFrame([(i, f"{words[i % 3]} {i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 1), int(i % 3 == 0)) for i in range(24)], "doc_id long, toxic int, quality int").write.parquet(f"{tmpdir_path}/labels.parquet")
    fitted, fit = [], K.fit_all
    monkeypatch.setattr(M.K, "fit_all", lambda df, pipeline: (fitted.append(df), fit(df, pipeline))[1])
    out = M.q_saved_model_scores(spark, tmpdir_path)
    rows = {r["doc_id"]: (r["sentiment_score"], r["vape_user"]) for r in out.collect()}
    assert rows == {i: [(1, "y"), (-1, "n"), (0, "n")][i % 3] for i in range(30)}
    assert len(fitted) == 2 and not any("regexp" in d._jdf.queryExecution().toString() for d in [*fitted, out])
