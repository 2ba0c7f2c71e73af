import corpus_pipeline as P
from tests.llm.fixtures import corpus, covered, frame

SF = "/root/testdata/sf0.001"


def test_passages_equal_brute_force(spark):
    rows = corpus()
    got = P.passages(spark, frame(spark, rows).select(P.COLUMNS), SF).collect()
    seqs = [(r[1] or "").split() for r in rows]
    gone = covered(seqs, 35)
    want = [(r[0], tuple(w for w, g in zip(s, m) if not g)) for r, s, m in zip(rows, seqs, gone)]
    assert sorted(((g.doc_id, tuple((g.text or "").split())) for g in got), key=str) == sorted(want, key=str)
    clean = {(r[0], r[1]) for r, m in zip(rows, gone) if not m.any()}
    assert len(clean) > 5 and clean <= {(g.doc_id, g.text) for g in got}  # unchanged


def test_language_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(P.COLUMNS)
    gibberish = [(10 ** 6 + i, "".join(chr(0x4E00 + (i * 977 + j * j * 131) % 20000) for j in range(400)), "en", "s", 400)
                 for i in range(30)]
    noise = spark.createDataFrame(gibberish, docs.schema)
    kept = {r.doc_id for r in P.language(spark, docs.unionByName(noise), SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.where("text rlike '[a-z]{3}'").collect()}
    assert clean <= kept and len(clean) > 900
    # a third of the noise is not learned from
    assert not {r.doc_id for r in noise.where(P.langid.bucket("doc_id", 3) == 1).collect()} & kept
