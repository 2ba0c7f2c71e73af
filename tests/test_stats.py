import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textlab.functions.dates import biweek_key, parse_twitter_time
from textlab.functions.stats_fn import erfc, normal_two_sided_p
from textlab.operators import metrics as M
from textlab.operators import stats as S


def test_kappa_hand(spark):
    df = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")], "a string, b string")
    r = S.cohen_kappa(df, "a", "b").first()
    assert (r["n_rows"], round(r["po"], 6), round(r["pe"], 6), round(r["kappa"], 6)) == (4, 0.75, 0.5, 0.5)


def test_kappa_self_is_one(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (2,)], "a int").withColumn("b", F.col("a"))
    assert S.cohen_kappa(df, "a", "b").first()["kappa"] == pytest.approx(1.0)


def test_rater_guard(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 0)], "k int, text string, s int")
    b = spark.createDataFrame([(1, "x", 1), (2, "z", 0)], "k int, text string, s int")
    r = S.align_raters(a, b, "k", "text", ["s"]).first()
    assert r["n_mismatch"] == 1 and r["kappa"] is None


def test_ztest_hand(spark):
    rows = [("a", "hit")] * 30 + [("a", "miss")] * 70 + [("b", "hit")] * 45 + [("b", "miss")] * 55
    df = spark.createDataFrame(rows, "g string, c string")
    r = {x["c"]: x for x in S.two_prop_ztest(df, "g", "c", ["hit", "miss", "other"]).collect()}
    assert round(r["hit"]["z"], 6) == -2.19089 and round(r["hit"]["p"], 6) == 0.02846
    assert r["other"]["count_1"] == 0 and r["other"]["z"] is None


def test_erfc_matches_math(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.7, 2.5, 4.0, -0.8]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erfc("x").alias("e")).collect()
    for x, r in zip(xs, got):
        assert r["e"] == pytest.approx(math.erfc(x), rel=2e-7, abs=1e-12)
    p = spark.createDataFrame([(1.959964,)], "z double").select(normal_two_sided_p("z")).first()[0]
    assert p == pytest.approx(0.05, abs=1e-6)


def test_pivot_and_proportions(spark):
    df = spark.createDataFrame([("v", "Negative"), ("v", "Positive"), ("n", "Neutral"), ("x", None)],
                               "g string, s string")
    cats = ["Negative", "Neutral", "Positive"]
    sh = S.count_proportions(S.count_pivot(df, "g", "s", cats, total="total"), "g", cats, "total").collect()
    assert {r["g"] for r in sh} == {"v", "n"}  # the unmapped row leaves both sides
    for r in sh:
        assert r["Negative"] + r["Neutral"] + r["Positive"] == pytest.approx(1.0)


def test_unlisted_categories_count_in_the_totals(spark):
    rows = [("a", "hit")] * 6 + [("a", "odd")] * 4 + [("b", "hit")] * 3 + [("b", "miss")] * 7 + [(None, "hit"), ("a", None)]
    df = spark.createDataFrame(rows, "g string, c string")
    r = {x["c"]: x for x in S.two_prop_ztest(df, "g", "c", ["hit", "miss"]).collect()}
    assert set(r) == {"hit", "miss"} and (r["hit"]["nobs_1"], r["hit"]["nobs_2"]) == (10, 10)
    assert {x["c"] for x in S.two_prop_ztest(df, "g", "c").collect()} == {"hit", "miss", "odd"}
    piv = S.count_pivot(df, "g", "c", ["hit"], total="n").collect()
    assert {(p["g"], p["hit"], p["n"]) for p in piv} == {("a", 6, 10), ("b", 3, 10)}


def test_null_labels_leave_only_where_told(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "id long, label int")
    assert M.stratified_folds(df, "label", "id", 5).count() == 30
    assert S.drop_null_labels(df, "label").count() == 20
    assert tuple(S.label_row_counts(df, "label").first()) == ("label", 30, 10, 20)


def test_raters_missing_repeated_and_changed_rows(spark):
    a = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(10)], "k int, text string, s int")
    b = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(1, 10)] + [(3, "t3", 1), (20, "new", 0)], "k int, text string, s int")
    r = S.align_raters(a, b, "k", "text", ["s"]).first()
    assert (r["n_rows"], r["n_mismatch"], r["kappa"]) == (8, 1 + 2 + 1, None)   # 0 missing, 3 twice, 20 new
    same = S.align_raters(a, a, "k", "text", ["s"]).first()
    assert (same["n_rows"], same["n_mismatch"], same["kappa"]) == (10, 0, 1.0)


def test_recode_unmapped_is_null(spark):
    df = spark.createDataFrame([("y",), ("n",), ("x",)], "v string")
    got = [r[0] for r in df.select(S.recode(F.col("v"), {"y": "vapers", "n": "non-vapers"})).collect()]
    assert got == ["vapers", "non-vapers", None]


def test_weighted_f1_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "label int, pred int")
    r = M.classification_metrics(df, "label", "pred").first()
    assert r["accuracy"] == pytest.approx(0.75) and r["weighted_f1"] == pytest.approx(0.75)


def test_stratified_folds_balanced_and_exact(spark):
    rows = [(i, i % 3 if i % 7 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = M.stratified_folds(df, "label", "id", 10, bucket_chars=1)
    sizes = got.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in sizes)
    # same as a plain per-class row number over the same key
    w = Window.partitionBy("label").orderBy(M.fold_key("id"), "id")
    ref = df.withColumn("fold", ((F.row_number().over(w) - 1) % 10).cast("int"))
    got, ref = got.select("id", "label", "fold"), ref.select("id", "label", "fold")
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


@pytest.mark.parametrize("s,key", [
    ("Tue Apr 27 19:49:05 +0000 2021", "2021-8"),
    ("Fri Jan 01 00:00:00 +0000 2021", "2021-26"),
    ("Mon Jan 04 00:00:00 +0000 2021", "2021-0"),
    ("Mon Dec 31 12:00:00 +0000 2018", "2018-0"),
])
def test_biweek_key(spark, s, key):
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(biweek_key(parse_twitter_time(F.col("t")))).first()[0] == key


def test_biweek_iso_year(spark):
    df = spark.createDataFrame([("Fri Jan 01 00:00:00 +0000 2021",)], "t string")
    assert df.select(biweek_key(parse_twitter_time(F.col("t")), iso_year=True)).first()[0] == "2020-26"


def test_malformed_time_is_null(spark):
    df = spark.createDataFrame([("not a time",)], "t string")
    assert df.select(parse_twitter_time(F.col("t"))).first()[0] is None
