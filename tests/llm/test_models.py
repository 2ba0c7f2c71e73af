import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import corpus, frame
from textlab.llm import bytecnn, imatch, langid

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.bucket("doc_id", 3) == 1
    model = langid.learn(docs.where(~held))
    got = langid.predict(docs.where(held), model)
    assert got.columns == [*docs.columns, "lang_pred", "score", "n_grams"]
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and 0 <= r[1] and r[2] <= 1
    back = langid.LanguageModel(model.languages, model.bits, model.totals)
    assert back.decide("") == back.decide("12 --") == ("und", 0.0, 0)
    assert back.decide("x")[0] in model.languages                       # a letter, but nothing known
    long = "the thing and that was " * 100_000
    assert back.decide(long)[0] == "en"


def test_bloom_counts_are_corrected_for_false_positives():
    bits = np.zeros((langid.SLOTS, 1), np.uint8)
    bits[:, 0] |= (np.arange(langid.SLOTS) % 2).astype(np.uint8)          # half of filter 0 is full
    m = langid.LanguageModel(["a", "b"], bits, [1, 2])
    assert abs(m.false[0] - 0.25) < 1e-9 and m.false[1] == 0
    text = " ".join(chr(0x4E00 + i * 7 % 5000) * 2 + chr(0x4E00 + i) for i in range(3000))
    assert m.decide(text)[1] < 0.05


def test_language_awkward_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == len(rows)
    assert {g.lang_pred for g in got if not any(c.isalpha() for c in g.text or "")} == {"und"}
    assert isinstance(got[0].score, float) and "xx" in {g.lang_pred for g in got}
    none = langid.learn(docs.limit(0))
    assert none.languages == [] and {g.lang_pred for g in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = bytecnn.learn(docs, labels.where(langid.bucket("doc_id", 5) != 0))
    held = docs.join(labels.where(langid.bucket("doc_id", 5) == 0), "doc_id")
    got = bytecnn.predict(held, model).collect()
    right = np.mean([g.predicted == g.quality for g in got])
    clean = np.mean([g.predicted for g in got if g.quality == 1])
    assert right >= 0.93 and clean >= 0.97 and len(got) > 50
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)


def test_quality_awkward_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (10, 0, 1), (10, 0, 1), (11, None, None), (None, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = bytecnn.predict(docs, bytecnn.learn(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert len({g.score for g in got if not g.text}) == 1                 # null counts as empty
    one = bytecnn.learn(docs, labels.limit(0))
    assert {g.predicted for g in bytecnn.predict(docs, one).collect()} == {1}


def test_chunks_cover_everything():
    raw = bytes(np.random.default_rng(1).integers(0, 256, 3 * bytecnn.CHUNK + 777).astype(np.uint8))
    m = bytecnn.fit([[b"good text"], [b"$$$ bad"]], np.array([1, 0], np.float32), steps=3)
    whole = m.responses(bytecnn.symbols(raw)).max(axis=0)
    assert np.allclose(m.pooled(raw), np.maximum(whole + m.bias, 0))
    assert 0 <= m.score(b"") <= 1
    s = bytecnn.symbols(b"a a a a b")
    assert (s > bytecnn.PAD).sum() == 2                                   # the third and fourth in a row


def test_imatch(spark):
    rows = corpus()
    got = imatch.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for g in got:
        i = next((r for r in rows if r[0] == g.doc_id and g.doc_id is not None), rows[-1])
        by_text.setdefault(i[1] or "", set()).add(g.fingerprint)
        assert g.n_chars == len(i[1] or "") and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert all(len(x) == 1 for x in by_text.values())
    # the edited text, in the defined order
    import hashlib
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    want = []
    for x, y in zip(order, order[1:] + order[:1]):
        a, b = x[1] or "", y[1] or ""
        h = len(a) // 2
        want.append((x[0], hashlib.sha256((a[:len(a) - h] + b[:h]).encode()).hexdigest()))
    assert sorted(((g.doc_id, g.edited_sha256) for g in got), key=str) == sorted(want, key=str)
    assert imatch.fingerprints(frame(spark, rows).limit(0)).count() == 0
    alone = imatch.fingerprints(frame(spark, rows[10:11])).first()
    assert alone.near_next == 1.0


def test_imatch_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(imatch, "PART_BYTES", 200)
    rows = [r for r in corpus() if r[0] is not None]
    a = {(g.doc_id, g.edited_sha256, g.near_edited) for g in imatch.fingerprints(frame(spark, rows)).collect()}
    monkeypatch.setattr(imatch, "PART_BYTES", 1 << 30)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert a == {(g.doc_id, g.edited_sha256, g.near_edited) for g in imatch.fingerprints(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_imatch_likeness_follows_common_terms():
    lex = np.full(1 << (imatch.TERM_BITS - 3), 255, np.uint8)
    rng = np.random.default_rng(2)
    w = [f"t{x}" for x in rng.integers(0, 10 ** 6, 300)]
    fp = lambda x: imatch.fingerprint(" ".join(x), lex)
    near = [imatch.likeness(fp(w), fp(w[:300 - k] + [f"z{i}" for i in range(k)])) for k in (0, 10, 150, 300)]
    assert near[0] == 1 and near[1] > near[2] > near[3] and near[3] < 0.05
    assert (fp(w) == fp(w[::-1] + w)).all()                               # distinct terms only
