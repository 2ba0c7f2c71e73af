"""All folds in the same passes: against Spark's fit of each fold, and against fits of one model."""

import random

import numpy as np
import pytest

from textlab.operators import classify as K
from textlab.operators import logistic as L


def rows(n, classes, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        y = i % classes
        out.append((i, ["common"] + [rnd.choice(words[20 * y:20 * y + 20] if rnd.random() < 0.35 else words) for _ in range(rnd.randint(1, 12))], y))
    return out + [(n, [], 0), (n + 1, None, 1), (n + 2, ["w1"], None)]


def test_every_fold_equals_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 200)
    df = spark.createDataFrame(rows(180, 3), "doc_id long, toks array<string>, label int").repartition(3)
    preds, per_fold, models = L.cross_validate(df, "doc_id", "label", 2, features=1 << 16, reg=0.05, tolerance=1e-10, steps=300)
    got = {r["id"]: r for r in preds.collect()}
    assert sorted(got) == list(range(182)) and models.passes < L.PASSES
    folded = L.stratified_folds(df.where("label is not null"), "label", "doc_id", 2)
    folded = folded.selectExpr("doc_id", "coalesce(toks, array()) toks", "label", "fold")
    for f in range(2):
        pipe = K.text_pipeline("toks", "label", num_features=1 << 16, reg=0.05, max_iter=300)
        pipe.getStages()[2].setTol(1e-12)
        for r in pipe.fit(folded.where(f"fold <> {f}")).transform(folded.where(f"fold = {f}")).collect():
            assert got[r["doc_id"]]["fold"] == f
            assert got[r["doc_id"]]["probability"] == pytest.approx(list(r["probability"]), abs=2e-4)
    assert sum(r["n"] for r in per_fold.collect()) == 182


@pytest.mark.parametrize("binary", [True, False])
def test_models_of_one_pass_equal_single_fits(spark, binary):
    df = spark.createDataFrame(rows(120, 2, 8), "doc_id long, toks array<string>, label int")
    folded = L.stratified_folds(df.where("label is not null"), "label", "doc_id", 3)
    blocks = L._blocks(folded, "doc_id", "toks", "label", "fold", [0, 1], 512).repartition(3).persist()
    together = L.fit_models(blocks, [0, 1], [0, 2, None], binary, 512, 0.01)
    passes = []
    for i, h in enumerate([0, 2, None]):
        one = L.fit_models(blocks, [0, 1], [h], binary, 512, 0.01)
        assert np.allclose(one.weights[:, 0], together.weights[:, i], atol=1e-8)
        assert one.loss[0] == pytest.approx(together.loss[i])
        passes.append(one.passes)
    assert together.passes == max(passes)
    blocks.unpersist()


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    y, use = rng.integers(0, 3, 7), rng.random((7, 2)) < 0.7
    for width, binary, t in ((3, False, y), (1, True, y % 2)):
        at = rng.normal(size=(7, 2, width))
        loss, rest = L._loss(at, t, use, binary)
        for i, j, k in np.ndindex(at.shape):
            moved = at.copy()
            moved[i, j, k] += 1e-6
            assert (L._loss(moved, t, use, binary)[0][j] - loss[j]) / 1e-6 == pytest.approx(rest[i, j, k], abs=1e-5)


def test_one_class_and_no_rows(spark):
    schema = "doc_id long, toks array<string>, label int"
    preds, per_fold, _ = L.cross_validate(spark.createDataFrame([(i, ["a"], 4) for i in range(6)], schema), "doc_id", "label", 2, features=64)
    assert [r["prediction"] for r in preds.collect()] == [4] * 6
    assert all(r["accuracy"] == 1.0 for r in per_fold.collect())
    preds, per_fold, _ = L.cross_validate(spark.createDataFrame([(1, ["a"], None)], schema), "doc_id", "label", 2, binary=True)
    assert preds.collect() == [] and per_fold.collect() == []


def test_a_pass_writes_one_gradient_for_each_core(spark, monkeypatch):
    """A task writes a gradient as large as the models in each pass, whatever its rows: there are no more tasks than cores."""
    rows = [(i, ["good" if i % 2 else "bad", f"w{i % 7}"], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, toks array<string>, label int")
    seen = []
    fit = L.fit_models
    monkeypatch.setattr(L, "fit_models", lambda blocks, *a, **b: (seen.append(blocks.rdd.getNumPartitions()), fit(blocks, *a, **b))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        preds, _, _ = L.cross_validate(df, "doc_id", "label", 3, binary=True, features=256)
        assert preds.count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism
