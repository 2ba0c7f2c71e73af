import public_tokenizers  # noqa: F401
import corpus_pipeline as P
import __spark_entry__ as E
from textlab.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_duplicates", "passages", "sequences"]
    q = E.queries()
    assert {x.split("_")[0] for x in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) < set(q) and q["pipeline"] is P.run and set(queries.SQL) <= set(E.oracle_sql())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == P.COLUMNS and out.dtypes == docs.select(P.COLUMNS).dtypes, name
        at = P.cut_lineage(out)
    n, m = docs.count(), at.count()
    assert 0 < m < n
    packed = P.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == m


def test_stages_take_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "one two", "en", None, 7), (2, "", "en", "s", 0)]):
        at = spark.createDataFrame(rows, schema)
        for _, stage in P.STAGES:
            at = P.cut_lineage(stage(spark, at, SF))
        assert at.count() <= 3
