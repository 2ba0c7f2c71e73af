"""Lexicon tables: idioms, emoji, pieces, and the same scores as the plan's own word table."""

import random

import pytest
from pyspark.sql import functions as F

from textlab.functions.wordlists import BOOSTERS, IDIOMS, LEXICON, NEGATIONS
from textlab.operators import lexicon as L
from textlab.operators import lexicon_table as T

norm = lambda v: v / (v * v + 15) ** 0.5


def table(spark, lexicon):
    return T.entries(spark.createDataFrame([(k, float(v)) for k, v in lexicon.items()], "phrase string, valence double"))


def scores(spark, lexicon, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in T.lexicon_compound_table(d, "text", table(spark, lexicon)).collect()}
    return [got[i] for i in range(len(texts))]


def test_idioms_golden(spark):
    cases = [(k, v) for k, v in IDIOMS.items()]
    cases += [("is the bomb", 3.0), ("not the bomb", -0.74 * 3.0), ("very very to die for", 3.0 + 0.293 + 0.95 * 0.293),
              ("is THE BOMB", 3.733), ("good kiss of death", 1.9 - 1.5), ("bad bad ass", -2.5 + 1.5), ("bus stop is bad", -2.5),
              ("never this good", 1.9 * 1.25), ("never so good", (1.9 + 0.293) * 1.25), ("never was so good", (1.9 + 0.293) * 1.25), ("without doubt good", 1.9),
              ("without any doubt good", 1.9), ("never good", -0.74 * 1.9), ("was upper hand but bad", 0.5 * 1.0 - 1.5 * 2.5)]
    lex = {k: v for k, v in (LEXICON | IDIOMS).items() if k not in ("the", "was", "for", "with", "this", "on", "and")}
    for (text, v), got in zip(cases, scores(spark, lex, [t for t, _ in cases])):
        assert got == pytest.approx(norm(v), abs=1e-9), text


def test_longer_entry_wins_and_overlaps_stay(spark):
    lex = table(spark, {"aa": 1, "aa bb": 2, "bb cc dd": 4, "cc": 8, "aa bb aa": 16, "Aa": -1, "x": 3, "": 5})
    assert sorted(map(tuple, lex.select("phrase", "n_words", "valence").collect())) == [
        ("aa", 1, 1.0), ("aa bb", 2, 2.0), ("aa bb aa", 3, 16.0), ("bb cc dd", 3, 4.0), ("cc", 1, 8.0)]
    rows = [(1, "aa bb cc dd"), (1, "aa bb cc dd"), (None, "aa bb aa cc"), (3, None), (4, ""), (5, "zz")]
    d = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", L.compound_tokens("text").alias("t"))
    got = sorted(map(str, T.lexicon_hits_table(d, "t", lex).collect()))
    row = lambda *v: "Row(doc_id={}, n_hits={}, n_idioms={}, sum_valence={})".format(*v)
    assert got == sorted([row(1, 2, 2, 6.0), row(1, 2, 2, 6.0), row(None, 2, 1, 24.0), row(3, 0, 0, 0.0), row(4, 0, 0, 0.0),
                          row(5, 0, 0, 0.0)])
    none = T.entries(spark.createDataFrame([], "phrase string, valence double"))
    assert {r["n_hits"] for r in T.lexicon_hits_table(d, "t", none).collect()} == {0}


def plain(tokens, lexicon):
    """Kept runs by comparing every run with every other."""
    low = [t.lower() for t in tokens]
    runs = [(i, n) for i in range(len(low)) for n in {len(k.split()) for k in lexicon}
            if i + n <= len(low) and " ".join(low[i:i + n]) in lexicon]
    return sorted((i, n) for i, n in runs if not any(j <= i and j + m >= i + n and m > n for j, m in runs))


def test_random_runs_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    rnd = random.Random(5)
    lex = {" ".join(rnd.choices(["aa", "bb", "cc"], k=rnd.randint(1, 5))): 1.0 for _ in range(40)}
    docs = [[rnd.choice(["aa", "bb", "cc", "DD"]) for _ in range(rnd.randint(0, 25))] for _ in range(60)]
    d = spark.createDataFrame([(t,) for t in docs], "t array<string>")
    entries = table(spark, lex).cache()
    got: dict = {}
    for r in T.phrase_hits(d, "t", entries, (), 3).collect():
        got.setdefault(r["key"], []).append((r["pos"], r["n_words"], r["before"]))
    keys = [r[0] for r in d.select(T.token_key("t")).collect()]
    for tokens, key in zip(docs, keys):
        want = [(i, n, tokens[max(0, i - 3):i][::-1]) for i, n in plain(tokens, lex)]
        assert sorted(got.get(key, [])) == want
    entries.unpersist()


def test_same_as_the_plan_literal(spark):
    words = sorted(LEXICON) + sorted(BOOSTERS) + sorted(NEGATIONS) + ["but", "BAD", "VERY", "Good!", "ok??", "don't", "xx"]
    words = [w for w in words if w not in ("never", "without")]
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 30))) for _ in range(200)] + ["", "  "]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {r[0]: r[1] for r in d.select("doc_id", L.lexicon_compound("text")).collect()}
    for i, got in enumerate(scores(spark, LEXICON, texts)):
        assert got == pytest.approx(want[i], abs=1e-9), texts[i]
    assert scores(spark, LEXICON, [None, "good"])[0] is None
    assert spark.createDataFrame([(None,)], "t string").select(L.lexicon_compound("t")).first()[0] is None


def test_emoji(spark):
    d = spark.createDataFrame([(0, "so\U0001F600!"), (1, "plain ☺x"), (2, None), (3, "no emoji")], "doc_id long, text string")
    got = {r[0]: r[1] for r in d.select("doc_id", T.describe_emoji("text")).collect()}
    assert got == {0: "so grinning face !", 1: "plain  white smiling face x", 2: None, 3: "no emoji"}
    said = d.withColumn("text", T.describe_emoji("text"))
    s = {r[0]: r[1] for r in T.lexicon_compound_table(said, "text", table(spark, {"grinning face": 2.0})).collect()}
    assert s[0] == pytest.approx(norm(2.0 + 0.293 + 0.292)) and s[3] == 0.0


def test_two_hundred_thousand_entries_by_shuffle(spark):
    """A table above the broadcast threshold is joined by shuffle, with the same result."""
    big = spark.range(200_000).select(F.concat(F.lit("zz"), "id").alias("phrase"), F.lit(1.0).alias("valence"))
    small = spark.createDataFrame([("good", 1.9), ("the bomb", 3.0)], "phrase string, valence double")
    d = spark.createDataFrame([(0, "good zz77 the bomb"), (1, "not good zz199999")], "doc_id long, text string")
    d = d.select("doc_id", L.compound_tokens("text").alias("t"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got = []
    for limit in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got.append(sorted(map(tuple, T.lexicon_hits_table(d, "t", T.entries(small.unionByName(big))).collect())))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got[0] == got[1] == [(0, 3, 1, 5.9), (1, 2, 0, 2.9)]


def test_words_that_start_no_entry_leave_in_the_row(spark, monkeypatch):
    """The same hits with the filter in the row and, for lexicons of many first words, without it."""
    lex = T.entries(spark.createDataFrame([("good", 1.0), ("Not good", -1.0), ("very very bad", -2.0)], "phrase string, valence double"))
    d = spark.createDataFrame([(1, ["so", "Good", None, "not", "good"]), (2, ["very", "very", "very", "bad", "x"]), (3, []), (4, None)], "doc_id int, t array<string>")
    got = {}
    for heads in (10_000, 2):
        monkeypatch.setattr(T, "HEADS", heads)
        hits = T.phrase_hits(d, "t", lex, before=2)
        got[heads] = sorted(map(str, hits.collect()))
        plan = hits._jdf.queryExecution().analyzed().toString()
        assert ("filter(sequence" in plan) == (heads > 2)
    assert got[10_000] == got[2] and len(got[2]) == 3
