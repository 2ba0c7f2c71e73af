"""Group statistics.

Every function aggregates first (partial + final hash aggregation, so a hot
group is combined map-side) and only then works on the tiny aggregated table.
No join or window ever sees the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.clean import _c, map_literal
from textlab.functions.stats_fn import normal_two_sided_p
from textlab.session import cut_lineage

SENTIMENT_NAMES = {-1: "Negative", 0: "Neutral", 1: "Positive"}
USER_GROUPS = {"y": "vapers", "n": "non-vapers"}


def recode(col, mapping: dict) -> Column:
    """Literal map; a value outside the map becomes null."""
    return F.try_element_at(map_literal(mapping), _c(col))


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    """P5: rows with a label.  The only place where unlabelled rows leave;
    :func:`label_row_counts` reports how many."""
    return df.where(F.col(label).isNotNull())


def label_row_counts(df: DataFrame, label: str) -> DataFrame:
    """P5: one row (label, n_before, n_dropped, n_after)."""
    return df.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count_if(F.col(label).isNull()).alias("n_dropped"),
                  F.count(label).alias("n_after")).select(F.lit(label).alias("label"), "*")


def count_pivot(df: DataFrame, row: str, col: str, values: list, total: str | None = None) -> DataFrame:
    """A1: counts per (row, col) unstacked to one column per value; absent = 0.
    Rows whose row or col key is null are left out.  ``total`` names a column
    with the count over all non-null values of ``col``, listed or not."""
    # Null keys are dropped after the aggregation, on the small result: a
    # pre-filter would be pushed into the scan and evaluate an expensive
    # ``col`` expression twice per row.
    n = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("__n"))
    cells = [F.coalesce(F.sum(F.when(F.col(col) == v, F.col("__n"))), F.lit(0)).alias(str(v)) for v in values]
    out = n.groupBy(row).agg(*cells, F.sum(F.when(F.col(col).isNotNull(), F.col("__n"))).alias("__total"))
    out = out.where(F.col(row).isNotNull() & (F.col("__total") > 0))
    return out.withColumnRenamed("__total", total) if total else out.drop("__total")


def count_proportions(pivot: DataFrame, row: str, values: list, total: str) -> DataFrame:
    """A2 (with A9): each count divided by its row total over all categories."""
    return pivot.select(row, *[F.try_divide(F.col(f"`{v}`").cast("double"), F.col(total)).alias(str(v)) for v in values])


def two_prop_ztest(df: DataFrame, group: str, cat: str, categories: list | None = None) -> DataFrame:
    """Pooled two-proportion z-test per category, two-sided normal p.

    Exactly two groups; group 1 is the alphabetically first.  Totals run over
    every non-null category.  ``categories`` picks and completes the rows of the
    result (one absent from the data counts 0); None reports every category of
    the data.  Output: (cat, count_1, nobs_1, count_2, nobs_2, z, p)."""
    n = cut_lineage(df.groupBy(group, cat).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col(group).isNotNull() & F.col(cat).isNotNull()))
    # Long form: the two group totals are two numbers, the counts conditional sums of each
    # category, so an open category column stays spread over its keys.
    totals = n.groupBy(group).agg(F.sum("n").alias("n")).orderBy(group).limit(3).collect()
    names, nobs = [r[0] for r in totals] + [None] * 2, [r["n"] for r in totals] + [0, 0]

    def count(i: int) -> Column:
        own = F.col(group) == F.lit(names[i]) if names[i] is not None else F.lit(False)
        return F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).cast("bigint").alias(f"count_{i + 1}")

    g = n.groupBy(cat).agg(count(0), count(1))
    if categories is not None:
        listed = df.sparkSession.createDataFrame([(c,) for c in categories], [cat]).select(F.col(cat).cast(df.schema[cat].dataType).alias(cat))
        g = listed.join(g, cat, "left").select(cat, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("count_1", "count_2")])
    g = g.select(cat, "count_1", F.lit(nobs[0]).cast("bigint").alias("nobs_1"), "count_2", F.lit(nobs[1]).cast("bigint").alias("nobs_2"),
                 F.lit(len(totals)).alias("n_groups"))
    p1 = F.try_divide(F.col("count_1").cast("double"), F.col("nobs_1"))
    p2 = F.try_divide(F.col("count_2").cast("double"), F.col("nobs_2"))
    pooled = F.try_divide((F.col("count_1") + F.col("count_2")).cast("double"),
                          F.col("nobs_1") + F.col("nobs_2"))
    var = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("nobs_1")) + F.try_divide(F.lit(1.0), F.col("nobs_2")))
    z = F.when(F.col("n_groups") == 2, F.try_divide(p1 - p2, F.sqrt(var)))
    return (g.withColumn("z", z).withColumn("p", normal_two_sided_p(F.col("z")))
             .drop("n_groups"))


def _kappa_from_confusion(conf: DataFrame, a: str, b: str, n: str = "n", bad: str | None = None,
                          by: list[str] | None = None) -> DataFrame:
    """n_rows, po, pe, kappa (and the summed ``bad`` column as n_mismatch) from a
    small confusion table (by..., a, b, n) -- one aggregation chain, no join.
    Pairs with a null label count only towards ``bad``."""
    by = list(by or [])
    ka, kb = F.col(a).cast("string"), F.col(b).cast("string")
    valid = ka.isNotNull() & kb.isNotNull()
    nn = F.when(valid, F.col(n)).otherwise(F.lit(0)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    badc = (F.col(bad) if bad else F.lit(0)).cast("bigint")
    long = (conf.select(*by, ka.alias("k"), nn.alias("na"), zero.alias("nb"),
                        F.when(valid & (ka == kb), F.col(n)).otherwise(F.lit(0)).cast("bigint").alias("nd"),
                        badc.alias("bad"))
                .unionByName(conf.select(*by, kb.alias("k"), zero.alias("na"), nn.alias("nb"),
                                         zero.alias("nd"), zero.alias("bad"))))
    per_k = long.groupBy(*by, "k").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "nd", "bad")])
    tot = per_k.groupBy(*by).agg(F.sum("na").alias("n_rows"), F.sum("nd").alias("n_agree"),
                                 F.sum(F.col("na") * F.col("nb")).alias("nab"), F.sum("bad").alias("n_mismatch"))
    po = F.try_divide(F.col("n_agree").cast("double"), F.col("n_rows"))
    pe = F.try_divide(F.col("nab").cast("double"), F.col("n_rows") * F.col("n_rows"))
    return tot.select(*by, F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
                      F.coalesce(F.col("n_mismatch"), F.lit(0)).cast("bigint").alias("n_mismatch"),
                      po.alias("po"), pe.alias("pe"),
                      F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns (one row: n_rows, po, pe, kappa).
    Rows with a null label are left out."""
    conf = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return _kappa_from_confusion(conf, a, b).drop("n_mismatch")


def align_raters(a: DataFrame, b: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """Two annotation tables aligned by ``key``.  A key that is on one side
    only, repeated, null or has different texts is a mismatch (as many as the
    rows of its larger side).  Kappa per label column, null when any mismatch
    exists (the reference refuses to compare then).

    One aggregation by key over both tables, on text digests and labels only
    (partial sums before the shuffle, no row multiplies), then one confusion
    table for all labels.  Output: (label, n_rows, n_mismatch, kappa)."""
    def side(df, s):
        return df.select(F.col(key).alias("key"), F.lit(s).alias("side"), F.md5(text).alias("digest"),
                         *[F.col(l).cast("string").alias(f"l{i}") for i, l in enumerate(labels)])

    in_a, in_b = F.col("side") == 0, F.col("side") == 1
    both = side(a, 0).unionByName(side(b, 1)).groupBy("key").agg(
        F.count_if(in_a).alias("na"), F.count_if(in_b).alias("nb"),
        F.max(F.when(in_a, F.col("digest"))).alias("da"), F.max(F.when(in_b, F.col("digest"))).alias("db"),
        *[F.max(F.when(s, F.col(f"l{i}"))).alias(f"{n}{i}") for i in range(len(labels)) for s, n in ((in_a, "a"), (in_b, "b"))])
    fine = F.col("key").isNotNull() & (F.col("na") == 1) & (F.col("nb") == 1) & (F.col("da") == F.col("db"))
    bad = F.when(F.coalesce(fine, F.lit(False)), F.lit(0)).otherwise(F.greatest("na", "nb"))
    one = (F.col("na") == 1) & (F.col("nb") == 1)
    long = both.select(bad.alias("bad"), F.explode(F.array(*[F.struct(
        F.lit(l).alias("label"), F.when(one, F.col(f"a{i}")).alias("x"), F.when(one, F.col(f"b{i}")).alias("y"))
        for i, l in enumerate(labels)])).alias("r"))
    conf = long.groupBy("r.label", "r.x", "r.y").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    k = _kappa_from_confusion(conf, "x", "y", bad="bad", by=["label"])
    return k.select("label", "n_rows", "n_mismatch", F.when(F.col("n_mismatch") == 0, F.col("kappa")).alias("kappa"))
