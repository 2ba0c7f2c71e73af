"""Resumable append: stopped and repeated runs give each key once."""

import pytest

from textlab.sources import posts as S


def test_stopped_and_repeated_batches(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/out"
    frame = lambda rows: spark.createDataFrame(rows, "id string, v int")
    assert S.append_new(frame([("a", 2), ("a", 1), ("b", 3), (None, 7), (None, 7)]), path, "one", "id")
    assert not S.append_new(frame([("a", 2), ("a", 1), ("b", 3), (None, 7), (None, 7)]), path, "one", "id")

    # a run that fails while it writes: no row of it counts, and the next run goes through
    broken = frame([("c", 1), ("d", 2)]).selectExpr("id", "if(id = 'd', int(raise_error('stopped')), v) v")
    with pytest.raises(Exception, match="stopped"):
        S.append_new(broken, path, "two", "id")
    # a run that ends between writing and committing
    frame([("c", 99)]).write.mode("overwrite").parquet(f"{path}/_staged-two")
    assert spark.read.parquet(path).count() == 4
    assert S.append_new(frame([("c", 1), ("d", 2), ("b", 9)]), path, "two", "id")
    got = sorted(((r["id"] or "", r["v"], r["batch"]) for r in spark.read.parquet(path).collect()))
    assert got == [("", 7, "one"), ("", 7, "one"), ("a", 1, "one"), ("b", 3, "one"), ("c", 1, "two"), ("d", 2, "two")]
    assert S.append_new(frame([]), path, "three", "id") and spark.read.parquet(path).count() == 6
