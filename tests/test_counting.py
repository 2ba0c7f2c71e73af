"""Steps that all text queries share: each is made once for a text, counts equal plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.operators import phrases as P
from textlab.operators import topics as TP


def test_noise_steps_are_bound_once(spark):
    """Unbound, the plan held the whitespace pass once for every reader of its result."""
    d = spark.createDataFrame([("Mail me@x.com  it's http://t.co/a @bob 1.5 + 2j ok",), (None,)], "t string")
    out = d.select(C.remove_noise("t").alias("x"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4
    assert [r["x"] for r in out.collect()] == ["Mail its   ok", None]


def test_bag_and_topic_counts_leave_out_null_tokens(spark):
    docs = [(1, ["b", "a", None, "b"]), (2, []), (2, None), (1, ["c", None, None]), (None, ["a"])]
    d = spark.createDataFrame(docs, "t int, toks array<string>")
    bags = [r["b"] for r in d.select(P.bag_of_words("toks").alias("b")).collect()]
    assert [b if b is None else [tuple(x) for x in b] for b in bags] == [[("a", 1), ("b", 2)], [], None, [("c", 1)], [("a", 1)]]
    got = {(r["t"], r["word"]): r["tf"] for r in TP.term_counts(d, "t", "toks").collect()}
    assert got == Counter((t, w) for t, ws in docs for w in ws or [] if w)


def test_topic_products_equal_plain_sums(spark, monkeypatch):
    """Any size of piece gives the same cosines; no row is made of a pair of topics of a word."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(int(t), f"w{w}", float(x)) for t in (9, 1, 4, 7) for w, x in enumerate(rng.random(40)) if x > 0.4] + [(5, "alone", 2.0), (None, "w1", 1.0)]
    d = spark.createDataFrame(rows, "topic int, word string, weight double").repartition(5)
    vec = {t: {w: x for u, w, x in rows if u == t} for t in (1, 4, 5, 7, 9)}
    norm = {t: sum(x * x for x in v.values()) ** 0.5 for t, v in vec.items()}
    for piece in (1 << 21, 8):
        monkeypatch.setattr(TP, "_PIECE", piece)
        out = TP.topic_cosine(d, "topic")
        got = {(r["topic_a"], r["topic_b"]): r["cosine"] for r in out.collect()}
        assert len(got) == 10
        for (a, b), c in got.items():
            assert abs(c - sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items()) / norm[a] / norm[b]) < 1e-9
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_read_written_tokens(spark, tmpdir_path):
    """The clusters' filters meet a written column, not the tokenizer below the deal of the rows."""
    from textlab.plans import models as M
    rows = [(i, ("cat dog bird fish " if i % 2 else "stock bond fund price ") * 3 + f"word{i % 5}", "en", f"src{i % 3}") for i in range(60)] + [(99, "1 2", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmpdir_path}/documents.parquet")
    seen, kept = [], M.CL.cluster_topics
    try:
        M.CL.cluster_topics = lambda df, *a, **b: seen.append(df) or kept(df, *a, **b)
        docs = M._doc_clusters(spark, tmpdir_path, 2)
    finally:
        M.CL.cluster_topics = kept
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert docs.count() == 61 and docs.where("topic = -1").count() == 1
