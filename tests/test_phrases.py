import random

from pyspark.sql import functions as F

from textlab.operators import phrases as P


def greedy(tokens, phrases):
    """Reference behaviour: left-to-right, non-overlapping."""
    out, pend = [], None
    for w in tokens:
        if pend is None:
            pend = w
        elif f"{pend}_{w}" in phrases:
            out.append(f"{pend}_{w}")
            pend = None
        else:
            out.append(pend)
            pend = w
    if pend is not None:
        out.append(pend)
    return out


def run_both(spark, docs, phrases):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, toks array<string>")
    lit = {r["id"]: r["o"] for r in df.select("id", P.apply_phrases("toks", list(phrases)).alias("o")).collect()}
    ph = spark.createDataFrame([(p,) for p in sorted(phrases)], "phrase string")
    joined = P.apply_phrases_df(df, "id", "toks", ph, "o")
    jn = {r["id"]: r["o"] for r in joined.select("id", "o").collect()}
    return lit, jn


def test_golden(spark):
    lit, jn = run_both(spark, ["a new york city new york".split()], {"new_york", "york_city"})
    assert lit[0] == jn[0] == "a new_york city new_york".split()


def test_random_against_greedy_loop(spark):
    rnd = random.Random(7)
    vocab = list("abcde")
    phrases = {f"{a}_{b}" for a in vocab for b in vocab if rnd.random() < 0.4}
    docs = [[rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] for _ in range(60)]
    lit, jn = run_both(spark, docs, phrases)
    for i, d in enumerate(docs):
        assert lit[i] == greedy(d, phrases) == jn[i]


def test_phrase_learn_formula(spark):
    docs = [["new", "york", "is", "big"]] * 8 + [["york", "is", "old"]] * 2
    df = spark.createDataFrame([(d,) for d in docs], "toks array<string>")
    got = {(r["w1"], r["w2"]): r["score"] for r in P.phrase_learn(df, "toks", 5, 0.0).collect()}
    uni = {"new": 8, "york": 10, "is": 10, "big": 8, "old": 2}
    bi = {("new", "york"): 8, ("york", "is"): 10, ("is", "big"): 8, ("is", "old"): 2}
    v = len(uni) + len(bi)
    want = {k: (n - 5) / uni[k[0]] / uni[k[1]] * v for k, n in bi.items() if n > 5}
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) < 1e-12


def test_bigram_and_bow(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["b"])], "id long, toks array<string>")
    bi = {(r["w1"], r["w2"]): r["n"] for r in P.bigram_counts(df, "toks").collect()}
    assert bi == {("a", "b"): 2, ("b", "a"): 1}
    voc = {r["token"]: (r["df"], r["cf"]) for r in P.vocabulary(P.doc_bow(df, "id", "toks")).collect()}
    assert voc == {"a": (1, 2), "b": (2, 3)}


def test_lemmatize_pos(spark):
    df = spark.createDataFrame([(["people", "were", "running", "the"],)], "t array<string>")
    assert df.select(P.lemmatize_pos("t")).first()[0] == ["person", "running"]


def test_merging_neither_shuffles_texts_nor_depends_on_the_way(spark, monkeypatch):
    """Bounded phrase tables are merged in the tasks, in parts of a batch; larger ones are joined."""
    rnd = random.Random(9)
    vocab = ["a", "b", "c", "a_b", "ä"]
    phrases = sorted({f"{a}_{b}" for a in vocab for b in vocab if rnd.random() < 0.4})
    docs = [(i, [rnd.choice(vocab) for _ in range(rnd.randint(0, 12))]) for i in range(80)] + [(None, ["a", "b"]), (90, None), (91, []), (92, ["a"])]
    df = spark.createDataFrame(docs, "id long, toks array<string>")
    ph = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    monkeypatch.setattr(P, "TOKENS", 7)
    inside = P.apply_phrases_df(df, "id", "toks", ph)
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "MOST_PHRASES", 0)
    joined = P.apply_phrases_df(df, "id", "toks", ph)
    got = {r["id"]: r["phrased"] for r in inside.collect()}
    assert inside.columns == joined.columns and got == {r["id"]: r["phrased"] for r in joined.collect()}
    assert got[None] == ["a", "b"] and got[90] is None and got[91] == []
    assert all(got[i] == greedy(ws, set(phrases)) for i, ws in docs if i is not None and ws)
    none = P.apply_phrases_df(df, "id", "toks", ph.limit(0)).collect()
    assert all(r["phrased"] == r["toks"] for r in none)


def test_slices_of_pairs_count_the_same_and_leave_no_files(spark, monkeypatch):
    import os

    from textlab.session import tables_dir
    docs = [["new", "york", "is", "big"]] * 8 + [["york", "is", "old"]] * 2 + [["x"], [], None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, toks array<string>")
    one = sorted(map(tuple, P.phrase_learn(df, "toks", 2, 0.5).collect()))
    before = set(os.listdir(tables_dir(spark).removeprefix("file:")))
    monkeypatch.setattr(P, "SLICE", 10)
    assert one and sorted(map(tuple, P.phrase_learn(df, "toks", 2, 0.5).collect())) == one
    assert len(set(os.listdir(tables_dir(spark).removeprefix("file:"))) - before) == 1  # the phrases only
