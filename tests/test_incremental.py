"""Crawls added one after the other give what one batch gives."""

import random

import pytest

from textlab.operators import incremental as I
from textlab.operators.ingest import first_and_count

SCHEMA = "k string, id string, ts long, body string"


def rows(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "hot", *"abcdefgh", None]), rnd.choice([str(rnd.randint(1, 40)), "x9", None]),
             rnd.choice([None, rnd.randint(0, 5)]), rnd.choice(["p", "q", None])) for _ in range(n)]


def found(df):
    return sorted(map(str, df.select("k", "id", "ts", "body", "n").collect()))


def test_day_by_day_equals_one_batch(spark, tmpdir_path):
    path = f"{tmpdir_path}/state"
    days = [rows(s) for s in range(4)] + [[]]
    with pytest.raises(ValueError):
        I.first_and_count_state(spark, path, "k")
    for d, day in enumerate(days):
        frame = spark.createDataFrame(day, SCHEMA)
        assert I.add_crawl(frame, path, f"day{d}", "k", "id", "ts")
        assert not I.add_crawl(frame, path, f"day{d}", "k", "id", "ts")
        if d == 2:
            I.compact(spark, path)
            I.drop_old(spark, path)
        whole = spark.createDataFrame(sum(days[:d + 1], []), SCHEMA)
        assert found(I.first_and_count_state(spark, path, "k")) == found(first_and_count(whole, "k", "id", "ts"))


def test_stopped_runs_leave_nothing(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/state"
    one, two = (spark.createDataFrame(rows(s), SCHEMA) for s in (7, 8))
    I.add_crawl(one, path, "one", "k", "id", "ts")
    before = found(I.first_and_count_state(spark, path, "k"))
    commit = I._commit
    monkeypatch.setattr(I, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    for act in (lambda: I.add_crawl(two, path, "two", "k", "id", "ts"),):
        with pytest.raises(RuntimeError, match="stopped"):
            act()
    assert found(I.first_and_count_state(spark, path, "k")) == before
    monkeypatch.setattr(I, "_commit", commit)
    with pytest.raises(RuntimeError, match="another writer"):
        I._commit(spark, path, 1, {})
    assert I.add_crawl(two, path, "two", "k", "id", "ts")
    I.drop_old(spark, path)
    whole = one.unionByName(two)
    assert found(I.first_and_count_state(spark, path, "k")) == found(first_and_count(whole, "k", "id", "ts"))


def test_stream(spark, tmpdir_path):
    path, data = f"{tmpdir_path}/state", f"{tmpdir_path}/in"
    for s in (1, 2):
        spark.createDataFrame(rows(s), SCHEMA).coalesce(1).write.mode("append").parquet(data)
        stream = spark.readStream.schema(SCHEMA).parquet(data)
        q = I.stream_crawls(stream, path, f"{tmpdir_path}/ckpt", "k", "id", "ts")
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    whole = spark.createDataFrame(rows(1) + rows(2), SCHEMA)
    assert found(I.first_and_count_state(spark, path, "k")) == found(first_and_count(whole, "k", "id", "ts"))
