import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.operators import ingest as I
from textlab.sources import posts as S


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_row_widths(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "p.csv"),
              'user_id,timestamp,posts\n1,t1,"hello\nworld"\n2,t2\n3,t3,x,extra\n')
    rows = S.read_posts_csv(spark, p, S.RAW_POSTS, keep_corrupt=True).orderBy("user_id").collect()
    assert [r["posts"] for r in rows] == ["hello\nworld", None, "x"]
    assert rows[0][S.CORRUPT] is None and rows[1][S.CORRUPT] is not None and rows[2][S.CORRUPT] is not None


def crawl_lines():
    def rec(i, user, text, rt=None, ext=None, rt_ext=None, when="Tue Apr 27 19:49:05 +0000 2021"):
        r = {"id_str": str(i), "created_at": when, "text": text, "user": {"id_str": user, "screen_name": f"u{user}"}}
        if ext:
            r["extended_tweet"] = {"full_text": ext}
        if rt:
            r["retweeted_status"] = {"id_str": rt, "text": "orig short"}
            if rt_ext:
                r["retweeted_status"]["extended_tweet"] = {"full_text": rt_ext}
        return json.dumps(r)
    return [
        rec(1, "10", "RT @a: orig short", rt="100", when="Tue Apr 27 19:49:05 +0000 2021"),
        rec(2, "11", "RT @a: orig short", rt="100", rt_ext="the full original", when="Mon Apr 26 10:00:00 +0000 2021"),
        rec(3, "99", "RT @a: orig short", rt="100"),          # not a member
        rec(4, "10", "my own post", ext="my own long post"),   # not a retweet
        rec(5, "11", "RT @b: other", rt="200"),
        "{broken json",
    ]


def test_unparsed_times_and_numeric_ids(spark):
    rows = [("k", "9", None, "null time"), ("k", "10", 50, "later"), ("k", "9", 40, "first nine"), ("k", "10", 40, "first ten"),
            ("m", "x", None, "no number"), ("m", "7", None, "number"), (None, "1", 1, "no key"), ("k", "9", 40, "first nine")]
    df = spark.createDataFrame(rows, "key string, id string, ts long, txt string")
    got = {r["key"]: (r["txt"], r["n"]) for r in I.first_and_count(df, "key", "id", "ts").collect()}
    assert got == {"k": ("first nine", 5), "m": ("number", 2)}


def test_crawl_to_unique_retweets(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "crawl.json"), "\n".join(crawl_lines()) + "\n")
    good, bad = S.read_crawl(spark, p)
    assert bad.count() == 1
    members = spark.createDataFrame([("10",), ("11",), ("11",)], "account_id string")
    out = {r["from_id"]: r for r in I.unique_retweets(good, members).collect()}
    assert set(out) == {"100", "200"}
    assert out["100"]["n_retweets"] == 2 and out["100"]["tweet_id"] == "2"  # earliest by time
    assert out["100"]["full_txt"] == "the full original"
    flat = {r["tweet_id"]: r["full_txt"] for r in I.flatten_tweet(good).collect()}
    assert flat["4"] == "my own long post" and flat["5"] == "orig short"


def test_face_filter(spark):
    one = {"face_num": 1, "faces": [{"attributes": {"age": {"value": 31}, "gender": {"value": "Female"}}}]}
    two = dict(one, face_num=2)
    none = {"face_num": 0, "faces": []}
    df = spark.createDataFrame([("a", json.dumps(one)), ("b", json.dumps(two)), ("c", json.dumps(none)),
                                ("d", '{"face_num": 1, "faces": [')], "id string, r string")
    rows = I.flatten_faces(df, "r").select("id", "age", "gender").collect()
    assert [(r["id"], r["age"], r["gender"]) for r in rows] == [("a", 31, "Female")]


def test_write_by_key_and_append(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, topic string")
    out = os.path.join(tmpdir_path, "by_topic")
    S.write_by_key(df, "topic", out)
    assert sorted(d for d in os.listdir(out) if d.startswith("topic=")) == ["topic=x", "topic=y"]
    tgt = os.path.join(tmpdir_path, "app")
    S.append_rows(df, tgt)
    S.append_rows(df, tgt)
    assert spark.read.parquet(tgt).count() == 6


def test_write_csv_reads_back(spark, tmpdir_path):
    rows = [("1", 'a "quoted", text'), ("2", "two\nlines"), ("3", None)]
    out = os.path.join(tmpdir_path, "csv")
    S.write_csv(spark.createDataFrame(rows, "id string, text string"), out)
    back = S.read_posts_csv(spark, out, T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_without_line_breaks_can_be_split(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "plain.csv")
    with open(path, "w") as f:
        f.write("id,text\n1,a\n2,b\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    assert S.read_posts_csv(spark, path, schema, multi_line=False).count() == 2


def test_observe_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    obs_df, obs = S.observe_counts(df, "progress", F.col("x") > 1)
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows_seen": 3, "rows_accepted": 2}


def test_model_save_load(spark, tmpdir_path):
    from textlab.operators import classify as K
    df = spark.createDataFrame([(["good", "fine"], 1), (["bad", "awful"], 0)] * 5, "toks array<string>, label int")
    model = K.fit_all(df, K.text_pipeline("toks", "label", binary=True, num_features=64))
    path = os.path.join(tmpdir_path, "model")
    K.save_model(model, path)
    again = K.load_model(path)
    a = [r[0] for r in model.transform(df).select("prediction").collect()]
    b = [r[0] for r in again.transform(df).select("prediction").collect()]
    assert a == b


def test_texts_of_one_row_group_go_to_many_tasks(spark, tmpdir_path, monkeypatch):
    """One row group is one task; a large one is dealt out, with the same rows."""
    from pyspark.sql import functions as F
    from textlab.sources import posts
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    assert posts.load_table(spark, tmpdir_path, "documents").rdd.getNumPartitions() == 1
    monkeypatch.setattr(posts, "FEW_TEXTS", 100)
    got = posts.load_table(spark, tmpdir_path, "documents")
    held = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) == 4 and sum(r["count"] for r in held) == 300
