import pytest
from pyspark.sql import functions as F

from textlab.functions.wordlists import SLICE_LEXICON
from textlab.operators import lexicon as L
from textlab.operators import stats as S
from textlab.plans.social import CATS, _named, scored_posts


def score(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_compound_normalisation(spark):
    assert score(spark, lambda c: L.lexicon_compound(c, {"aa": 1.5}), "aa aa") == pytest.approx(0.612372, abs=1e-6)


def test_compound_rules(spark):
    lex = {"good": 2.0}
    base = score(spark, lambda c: L.lexicon_compound(c, lex), "this is good")
    assert base > 0
    assert score(spark, lambda c: L.lexicon_compound(c, lex), "this is not good") < 0
    assert score(spark, lambda c: L.lexicon_compound(c, lex), "this is very good") > base
    assert score(spark, lambda c: L.lexicon_compound(c, lex), "this is good!!") > base
    assert score(spark, lambda c: L.lexicon_compound(c, lex), "this is GOOD") > base
    assert score(spark, lambda c: L.lexicon_compound(c, lex), "nothing here") == 0.0


def test_polarity_rules(spark):
    lex = {"good": 2.0}
    f = lambda toks: L.lexicon_polarity(toks, lex)
    sp = lambda c: F.split(c, " ")
    assert score(spark, lambda c: f(sp(c)), "good") == pytest.approx(0.5)
    assert score(spark, lambda c: f(sp(c)), "not good") == pytest.approx(-0.25)
    assert score(spark, lambda c: f(sp(c)), "very good") == pytest.approx(0.65)
    assert score(spark, lambda c: f(sp(c)), "none here") == 0.0


@pytest.mark.parametrize("word", ["don't", "don\u2019t", "dont", "do not", "can't", "haven't"])
def test_contracted_negation(spark, word):
    lex = {"like": 1.5}
    for f in (lambda c: L.lexicon_compound(c, lex), lambda c: L.lexicon_polarity(L.scoring_tokens(c), lex)):
        plain = score(spark, f, "I like it")
        assert plain > 0 > score(spark, f, f"I {word} like it")
        assert score(spark, f, f"I {word} like it") == pytest.approx(score(spark, f, "I do not like it"))


def test_compound_golden_values(spark):
    """Worked out from the published constants: v / sqrt(v * v + 15)."""
    lex = {"good": 2.0, "bad": -2.0}
    norm = lambda v: v / (v * v + 15) ** 0.5
    f = lambda c: L.lexicon_compound(c, lex)
    for text, v in [("is good", 2.0), ("very good", 2.293), ("very bad", -2.293), ("not good", -1.48),
                    ("not very good", -0.74 * 2.293), ("very not good", -0.74 * 2.0 - 0.95 * 0.293),
                    ("slightly good", 2.0 - 0.293), ("really is good", 2.0 + 0.95 * 0.293), ("is GOOD", 2.733),
                    ("good bad", 0.0), ("is good but bad", 2.0 * 0.5 - 2.0 * 1.5)]:
        assert score(spark, f, text) == pytest.approx(norm(v), abs=1e-9), text


def test_signed_confidence(spark):
    df = spark.createDataFrame([("POSITIVE", 0.9), ("NEGATIVE", 0.8)], "l string, s double")
    assert [r[0] for r in df.select(L.signed_score(F.col("l"), F.col("s"))).collect()] == [0.9, -0.8]


def test_label_maps(spark):
    df = spark.createDataFrame([("LABEL_0",), ("LABEL_1",), ("LABEL_2",), ("X",)], "l string")
    assert [r[0] for r in df.select(L.label_to_score(F.col("l"))).collect()] == [-1, 0, 1, None]
    assert [r[0] for r in df.select(L.label_to_flag(F.col("l"))).collect()] == ["n", "y", None, None]


def test_minimum_slice_fixture(spark):
    """FIXTURES 3: sf0.01, slice lexicon, [a-z]+ tokens -> known z-tests."""
    stopgap = lambda c: F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " ")
    posts = scored_posts(spark, "/root/testdata/sf0.01", SLICE_LEXICON, stopgap)
    z = {r["sentiment"]: r for r in S.two_prop_ztest(_named(posts), "vape_user", "sentiment", CATS).collect()}
    want = {"Negative": (8, 58, 86, 341, -1.895788, 0.057988),
            "Neutral": (34, 58, 124, 341, 3.204116, 0.001355),
            "Positive": (16, 58, 131, 341, -1.580723, 0.113941)}
    for k, (c1, n1, c2, n2, zz, p) in want.items():
        r = z[k]
        assert (r["count_1"], r["nobs_1"], r["count_2"], r["nobs_2"]) == (c1, n1, c2, n2)
        assert round(r["z"], 6) == zz and round(r["p"], 6) == p
