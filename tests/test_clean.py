from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.functions.slang import expand_slang


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_lda_noise_chain(spark):
    # FIXTURES: e-mail, @mention, quote, URL and complex-number removal in order.
    s = "Mail me@x.com  it's http://t.co/a @bob 1.5 + 2j ok"
    assert one(spark, C.remove_noise, s) == "Mail its   ok"


def test_tokenize_accents_length_and_underscore(spark):
    toks = one(spark, C.tokenize, "Café NAÏVE a _x ab12cd supercalifragilistic déjà-vu")
    assert toks == ["cafe", "naive", "ab", "cd", "deja", "vu"]


def test_length_filter(spark):
    assert one(spark, lambda c: C.keep_longer_than(F.split(c, ", ")), "a, bcd, efgh") == ["efgh"]


def test_stop_words_keep_duplicates_and_order(spark):
    out = one(spark, lambda c: C.remove_words(F.split(c, " "), ["the", "a"]), "the cat a cat the dog")
    assert out == ["cat", "cat", "dog"]


def test_bertopic_chain(spark):
    assert one(spark, C.clean_bertopic, "The CATS, were   running!! Über-fast") == "cats running überfast"


def test_clean_post_counts_characters(spark):
    s = "é" * 600 + "\n\n x"
    out = one(spark, C.clean_post, s)
    assert len(out) == 512 and set(out) == {"é"}


def test_clean_tweet(spark):
    s = "Love it 😀😀 :) see https://t.co/xyz  now ;-P"
    assert one(spark, C.clean_tweet, s) == "Love it see now"


def test_strip_normal(spark):
    assert one(spark, C.strip_normal, "https://pbs.img/p/abc_normal.jpg") == "https://pbs.img/p/abc.jpg"
    assert one(spark, C.strip_normal, "https://pbs.img/p/abc_normal") == "https://pbs.img/p/abc"


def test_slang_substring_mode_is_literal(spark):
    f = lambda c: expand_slang(c, "substring")
    assert one(spark, f, "but ur") == "bheyut heyheyur"
    assert one(spark, f, "thx u") == "thanks heyu"
    assert one(spark, f, "LOL ok") == "LOL ok"
    assert one(spark, f, "brb omw") == "be rInstagramht back on my way"


def test_slang_token_mode(spark):
    assert one(spark, lambda c: expand_slang(c, "token"), "thx u") == "thanks you"


def test_slang_table_has_87_keys():
    from textlab.functions.wordlists import SLANG_TABLE, slang_pairs
    assert len(SLANG_TABLE) == 109 and len(slang_pairs()) == 87
