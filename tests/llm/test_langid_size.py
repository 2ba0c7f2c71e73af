import random

import numpy as np
from pyspark.sql import functions as F

from textlab.llm import langid


def han(rng, n):
    return "".join(chr(0x4E00 + c) for c in rng.integers(0, 2000, n))


def corpus(spark, n=400):
    """Two languages without a common letter whose n-grams hardly repeat across texts, each text three times."""
    rng = np.random.default_rng(5)
    rows = [(i, t, "zh" if i % 2 else "ko") for i in range(n)
            for t in [han(rng, 600) if i % 2 else "".join(chr(0xAC00 + c) for c in rng.integers(0, 2000, 600))] * 3]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def foreign(spark):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60)), None)
                                  for i in range(20)] + [(20, None, None), (21, "12 -", None)], "doc_id long, text string, lang string")


def check(spark, model, docs):
    own = langid.predict(docs, model)
    assert own.count() == docs.count() and own.where("lang_pred <> lang or score < 0.95 or n_grams < 590").count() == 0
    other = langid.predict(foreign(spark), model).collect()
    assert len(other) == 22 and all(g.score < 0.1 for g in other)
    assert {(g.lang_pred, g.score, g.n_grams) for g in other if g.doc_id > 19} == {("und", 0.0, 0)}


def test_filter_grows_with_the_n_grams(spark, monkeypatch):
    # 120,000 n-grams a language would fill 2**16 slots to 97 %
    monkeypatch.setattr(langid, "SLOTS", 1 << 16)
    docs = corpus(spark)
    model = langid.learn(docs)
    assert len(model.bits) == langid.slots_for(120_000) and model.false.max() < 0.1
    check(spark, model, docs)


def test_a_filter_above_its_bound_is_sliced(spark, monkeypatch):
    docs = corpus(spark, 60)
    awkward = docs.unionByName(foreign(spark))
    whole = langid.learn(docs)
    want = {(r.doc_id, r.lang_pred, r.n_grams) for r in langid.predict(docs, whole).collect()}
    scores = {(r.doc_id, r.text): r for r in langid.predict(awkward, whole).collect()}
    monkeypatch.setattr(langid, "SLOTS", 1 << 16)
    monkeypatch.setattr(langid, "MOST_BYTES", 1 << 16)
    model = langid.learn(docs)
    assert model.bits is None and model.slices >= 4 and model.size <= langid.MOST_BYTES
    check(spark, model, docs)
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "score", "n_grams"] and got.where("score < 0.999999").count() == 0
    assert {(r.doc_id, r.lang_pred, r.n_grams) for r in got.collect()} == want
    assert langid.predict(docs.limit(0), model).count() == 0
    again = langid.predict(awkward, model).collect()
    assert len(again) == awkward.count()
    for r in again:
        one = scores[r.doc_id, r.text]
        assert r.n_grams == one.n_grams and abs(r.score - one.score) < 0.1  # other slots, other false positives


def test_slices_of_hashes(spark):
    h = langid.mix64(np.arange(3000, dtype=np.uint64))
    d = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "gram long")
    for n in (1, 2, 8, 1 << 11):
        assert [r[0] for r in d.select(langid.slice_column(n)).collect()] == langid.slice_of(h, n).tolist()
    for keys in (10, 8192, 9_000_000, 400_000_000):
        n = langid.slices_for(lambda n: keys // n, 17)
        assert langid.slots_for(keys // n, 17) * 17 <= langid.MOST_BYTES
        assert n == 1 or langid.slots_for(keys // (n // 2), 17) * 17 > langid.MOST_BYTES


def test_slots():
    assert langid.slots_for(0) == langid.slots_for(500_000) == langid.SLOTS
    assert langid.slots_for(4_000_000) == 1 << 25
    assert langid.slots_for(100, 17) * 17 <= langid.MOST_BYTES < langid.slots_for(9_000_000) * 17


def test_full_filter_says_nothing():
    m = langid.LanguageModel(["a", "b"], np.full((langid.SLOTS, 1), 1, np.uint8), [2, 1])
    assert m.decide("some text of no language")[1] == 0.0


def test_rare_n_grams_follow_the_total(spark, monkeypatch):
    rows = [(i, "the same words in every text", "en") for i in range(3000)] + [(9000 + i, "zqxj", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    noise = spark.createDataFrame([(1, "zqxj", None)], "doc_id long, text string, lang string")
    assert langid.predict(noise, langid.learn(docs)).first().score > 0.9  # 3 of some 75,000: above RARE
    monkeypatch.setattr(langid, "RARE", 1e-3)
    assert langid.predict(noise, langid.learn(docs)).first().score == 0.0
    assert langid.predict(docs.where(F.col("doc_id") == 1), langid.learn(docs)).first().score > 0.9


def test_pieces_give_what_whole_texts_give(monkeypatch):
    rng = random.Random(12)
    texts = ["", " ", "a", "a b", "a. b. c", "ab", "ΑΣ ΣΑΣ " * 9, "İstanbul " * 5, "x" * 40, " " * 90 + "word" + "." * 70 + "other"]
    texts += ["".join(rng.choice("abcé Σ.  12\n") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    whole = [langid.grams(t) for t in texts]
    for piece in (1, 2, 3, 16):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t, (h, letter) in zip(texts, whole):
            got, any_letter = langid.grams(t)
            assert any_letter == letter and sorted(got.tolist()) == sorted(h.tolist())


def test_grams_equal_a_plain_count():
    rng = random.Random(3)
    for _ in range(100):
        t = "".join(rng.choice("abc  .d1") for _ in range(rng.randrange(1, 60)))
        s = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        while "  " in s:
            s = s.replace("  ", " ")
        s = s.ljust(langid.N)
        every = [s[i:i + langid.N] for i in range(len(s) - langid.N + 1)]
        strong = [g for g in every if sum(c != " " for c in g) >= 2]
        got, letter = langid.grams(t)
        assert len(got) == len(strong or every) and len(set(got.tolist())) == len(set(strong or every)) and letter == bool(s.strip())
