import pytest
import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from textlab.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


def test_stream_scores_like_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(src)
    sink, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = ST.start_scoring(spark, src, sink, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = ST.scored(docs)
    assert got.count() == docs.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["sentiment"] for r in rows} <= {"Negative", "Neutral", "Positive"}
    assert df.columns == ["sentiment", "count_1", "nobs_1", "count_2", "nobs_2", "share_1", "share_2", "z", "p"]


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_fast_queries_smoke(spark):
    qs = E.queries()
    for name in ["clean_lda", "tokenize", "vocabulary", "unique_retweets", "topic_top_words", "biweekly_mean",
                 "stratified_folds", "json_flatten", "face_flatten", "topic_assign"]:
        df = qs[name](spark, SF)
        assert df.count() >= 0 and len(df.columns) > 0


def test_shared_folder_is_required_on_a_cluster():
    """Only a local master may go without spark.checkpoint.dir."""
    from types import SimpleNamespace
    from textlab import session

    class Unset:
        def isDefined(self):
            return False

    def fake(master):
        sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=Unset)),
                             getConf=lambda: {}, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc, conf={})

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(fake(master))
    assert session.ensure_checkpoint_dir(fake("local[2]"))


def test_intermediate_tables_are_deleted(spark):
    import glob

    from textlab.session import cut_lineage, drop_tables, tables_dir
    assert cut_lineage(spark.range(5)).count() == 5
    folder = tables_dir(spark).removeprefix("file:")
    assert glob.glob(folder + "/*")
    drop_tables(spark)
    assert not glob.glob(folder + "/*")


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from textlab.session import cut_lineage, drop_table
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tracker = env.mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"))
    assert tracker.shuffleStatuses().size() <= before and out.count() == 7
    drop_table(out)
    assert not os.path.exists(out._table.removeprefix("file:"))
