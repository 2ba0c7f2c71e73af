"""Classifier evaluation (A10-A12) and stratified fold assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def classification_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted F1 (as the common ``average='weighted'``),
    optionally per group ``by`` (e.g. fold).  One aggregation over the rows to
    a confusion table; everything after works on that small table."""
    by = list(by or [])
    conf = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))
    lab, prd = F.col(label).cast("string"), F.col(pred).cast("string")
    hit = (lab == prd)
    z = F.lit(0).cast("bigint")
    long = (conf.select(*by, lab.alias("c"), F.col("n").alias("support"),
                        F.when(hit, F.col("n")).otherwise(z).alias("tp"), z.alias("fp"))
                .unionByName(conf.select(*by, prd.alias("c"), z.alias("support"), z.alias("tp"),
                                         F.when(hit, z).otherwise(F.col("n")).alias("fp"))))
    per = long.groupBy(*by, "c").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                     F.sum("fp").alias("fp"))
    fn = F.col("support") - F.col("tp")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn), F.lit(0.0))
    per = per.withColumn("f1", f1)
    tot = per.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"),
                               F.sum(F.col("support") * F.col("f1")).alias("wf1"))
    return tot.select(*by, F.col("n").cast("bigint").alias("n"),
                      F.try_divide(F.col("correct").cast("double"), F.col("n")).alias("accuracy"),
                      F.try_divide(F.col("wf1"), F.col("n")).alias("weighted_f1"))


def fold_key(id_col: str, seed: int = 42):
    """Seeded shuffle key both engines can compute: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int, seed: int = 42,
                     bucket_chars: int = 3) -> DataFrame:
    """Adds ``fold``: within each class, rows ordered by a seeded hash are dealt
    round-robin to ``k`` folds, so fold sizes differ by at most one per class.

    A window over a whole class would put a third of the rows in one task.
    Instead the exact within-class rank is computed in two steps: rows are
    grouped into hash-prefix buckets (``16**bucket_chars`` per class; the
    prefix order is the hash order), bucket sizes give each bucket's starting
    offset on a tiny table, and the row number is taken inside (class, bucket)
    only."""
    key = fold_key(id_col, seed)
    d = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, bucket_chars))
    sizes = d.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "__bucket",
                           F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__offset"))
    # offsets: #classes x 16**bucket_chars rows; rows without a label are a class
    # of their own (dropping them is P5's business)
    offsets = offsets.select(F.col(label).alias("__l"), F.col("__bucket").alias("__b"), "__offset")
    d = d.join(offsets, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    w = Window.partitionBy(label, "__bucket").orderBy("__key", id_col)
    rank = F.col("__offset") + F.row_number().over(w) - 1
    return d.withColumn("fold", (rank % k).cast("int")).drop("__key", "__bucket", "__offset", "__l", "__b")


def mean_over_folds(per_fold: DataFrame, cols: list[str]) -> DataFrame:
    """Append the mean of each metric over folds (small table)."""
    w = Window.partitionBy()
    out = per_fold
    for c in cols:
        out = out.withColumn(f"mean_{c}", F.avg(c).over(w))
    return out
