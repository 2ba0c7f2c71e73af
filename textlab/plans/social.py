"""Label -> score -> compare-groups queries on the driver tables.

Stand-ins (SURVEY 5): a document is a post, ``labels.quality`` 1/0 plays the
user group y/n, the lexicon class of the text plays the sentiment class, and
``quality`` vs ``1 - toxic`` plays two raters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.clean import tokenize
from textlab.functions.wordlists import LEXICON
from textlab.operators import stats as S
from textlab.operators.lexicon import mean_valence, score_to_class
from textlab.plans import sql as Q
from textlab.sources.posts import load_table

CATS = ["Negative", "Neutral", "Positive"]


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def scored_posts(spark: SparkSession, sf: str, lexicon: dict = LEXICON, tokenizer=tokenize) -> DataFrame:
    """documents JOIN labels -> (doc_id, vape_user y/n, score, sentiment_score -1/0/1)."""
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    labels = load_table(spark, sf, "labels").select("doc_id", "quality")
    j = docs.join(labels, "doc_id")
    score = mean_valence(tokenizer(F.col("text")), lexicon)
    return j.select(
        "doc_id",
        S.recode(F.col("quality"), {1: "y", 0: "n"}).alias("vape_user"),
        score.alias("score"),
    ).withColumn("sentiment_score", score_to_class(F.col("score")))


def _named(df: DataFrame) -> DataFrame:
    """Group and class names as the reference maps them (unmapped -> null)."""
    return df.select(S.recode(F.col("vape_user"), S.USER_GROUPS).alias("vape_user"),
                     S.recode(F.col("sentiment_score"), S.SENTIMENT_NAMES).alias("sentiment"))


def q_sentiment_by_group_counts(spark, sf):
    return S.count_pivot(_named(scored_posts(spark, sf)), "vape_user", "sentiment", CATS)


def q_sentiment_by_group_share(spark, sf):
    piv = S.count_pivot(_named(scored_posts(spark, sf)), "vape_user", "sentiment", CATS, total="total")
    sh = S.count_proportions(piv, "vape_user", CATS, "total")
    return sh.select("vape_user", *[r6(F.col(c)).alias(c) for c in CATS])


def q_sentiment_by_user_flow(spark, sf):
    """M8 minimum slice: posts -> lexicon class -> groups -> pivot -> z-test."""
    z = S.two_prop_ztest(_named(scored_posts(spark, sf)), "vape_user", "sentiment", CATS)
    return z.select(
        "sentiment", "count_1", "nobs_1", "count_2", "nobs_2",
        r6(F.try_divide(F.col("count_1").cast("double"), F.col("nobs_1"))).alias("share_1"),
        r6(F.try_divide(F.col("count_2").cast("double"), F.col("nobs_2"))).alias("share_2"),
        r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


def q_two_prop_ztest(spark, sf):
    """A8 on a second grouping: language shares of the two quality groups."""
    docs = load_table(spark, sf, "documents").select("doc_id", "lang")
    labels = load_table(spark, sf, "labels").select("doc_id", "quality")
    df = docs.join(labels, "doc_id").select(
        S.recode(F.col("quality"), {1: "good", 0: "poor"}).alias("grp"), F.col("lang"))
    z = S.two_prop_ztest(df, "grp", "lang")
    return z.select("lang", "count_1", "nobs_1", "count_2", "nobs_2",
                    r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


def q_cohen_kappa(spark, sf):
    lab = load_table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("nontoxic"))
    k = S.cohen_kappa(lab, "quality", "nontoxic")
    return k.select(F.lit("quality_vs_nontoxic").alias("label"), "n_rows",
                    r6(F.col("po")).alias("po"), r6(F.col("pe")).alias("pe"), r6(F.col("kappa")).alias("kappa"))


def q_rater_agreement(spark, sf):
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    lab = load_table(spark, sf, "labels")
    a = docs.join(lab.select("doc_id", "quality", "toxic"), "doc_id")
    b = docs.join(lab.select("doc_id", (1 - F.col("toxic")).alias("quality"),
                             (1 - F.col("quality")).alias("toxic")), "doc_id")
    # a third annotation that lost rows, changed texts and has a row twice
    c = b.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    c = c.unionByName(c.where("doc_id % 13 = 0"))
    out = None
    for name, other in (("same", b), ("changed", c)):
        res = S.align_raters(a, other, "doc_id", "text", ["quality", "toxic"]).select(F.lit(name).alias("pair"), "*")
        out = res if out is None else out.unionByName(res)
    return out.select("pair", "label", "n_rows", "n_mismatch", r6(F.col("kappa")).alias("kappa"))


def q_drop_null_labels(spark, sf):
    """P5: posts left with a label after a left join."""
    docs = load_table(spark, sf, "documents").select("doc_id")
    lab = load_table(spark, sf, "labels").select("doc_id", S.recode(F.col("quality"), {1: "y", 0: "n"}).alias("vape_user"))
    return S.drop_null_labels(docs.join(lab, "doc_id", "left"), "vape_user")


def q_label_row_counts(spark, sf):
    """P5: the counts before and after dropping."""
    docs = load_table(spark, sf, "documents").select("doc_id")
    lab = load_table(spark, sf, "labels").select("doc_id", "quality")
    return S.label_row_counts(docs.join(lab, "doc_id", "left"), "quality")


def q_null_profile(spark, sf):
    """Value profile of a label column after a left join (nulls for
    unlabelled posts), with the per-value distinct source count."""
    docs = load_table(spark, sf, "documents").select("doc_id", "source")
    lab = load_table(spark, sf, "labels").select("doc_id", "quality")
    j = docs.join(lab, "doc_id", "left")
    return j.groupBy("quality").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count_distinct("source").alias("n_sources"))


def q_recode_labels(spark, sf):
    """Labels -> y/n -> 1/0 and sentiment -1/0/1 -> 0/1/2 (the training
    recodes); a value outside a map becomes null."""
    lab = load_table(spark, sf, "labels")
    flag = S.recode(F.col("quality"), {1: "y", 0: "n"})
    senti = F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0))
    return lab.select(
        "doc_id",
        S.recode(flag, {"y": 1, "n": 0}).alias("vape_user"),
        S.recode(senti, {-1: 0, 0: 1, 1: 2}).alias("sentiment"),
        S.recode(F.col("quality") + F.col("toxic"), {0: "none", 1: "one"}).alias("partial"))


# ---------------------------------------------------------------- oracle SQL

def _scored_sql(lexicon: dict = LEXICON) -> str:
    score = Q.mean_valence(Q.tokenize("d.text"), lexicon)
    return f"""
    SELECT d.doc_id,
           CASE l.quality WHEN 1 THEN 'y' WHEN 0 THEN 'n' END AS vape_user,
           {score} AS score
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def _named_sql() -> str:
    return f"""
    SELECT CASE vape_user WHEN 'y' THEN 'vapers' WHEN 'n' THEN 'non-vapers' END AS vape_user,
           CASE {Q.score_class('score')} WHEN -1 THEN 'Negative' WHEN 0 THEN 'Neutral'
                WHEN 1 THEN 'Positive' END AS sentiment
    FROM ({_scored_sql()})"""


def _counts_sql() -> str:
    return f"""
    SELECT vape_user,
           CAST(count(*) FILTER (WHERE sentiment = 'Negative') AS BIGINT) AS Negative,
           CAST(count(*) FILTER (WHERE sentiment = 'Neutral') AS BIGINT) AS Neutral,
           CAST(count(*) FILTER (WHERE sentiment = 'Positive') AS BIGINT) AS Positive
    FROM ({_named_sql()}) WHERE vape_user IS NOT NULL AND sentiment IS NOT NULL
    GROUP BY vape_user"""


def _ztest_sql(long_sql: str, cat: str) -> str:
    """``long_sql`` has (grp, cat, cnt, nobs) for every (group, category)."""
    p = "p_pool"
    z = (f"(count_1 / nobs_1 - count_2 / nobs_2) / "
         f"sqrt({p} * (1 - {p}) * (1.0 / nobs_1 + 1.0 / nobs_2))")
    return f"""
    WITH g AS (
      SELECT {cat},
             CAST(arg_min(cnt, grp) AS BIGINT) AS count_1, CAST(arg_min(nobs, grp) AS BIGINT) AS nobs_1,
             CAST(arg_max(cnt, grp) AS BIGINT) AS count_2, CAST(arg_max(nobs, grp) AS BIGINT) AS nobs_2
      FROM ({long_sql}) GROUP BY {cat}),
    zz AS (
      SELECT *, CAST(count_1 + count_2 AS DOUBLE) / (nobs_1 + nobs_2) AS p_pool FROM g),
    z2 AS (SELECT *, CASE WHEN p_pool > 0 AND p_pool < 1 THEN {z} END AS z FROM zz)
    SELECT {cat}, count_1, nobs_1, count_2, nobs_2, z,
           CASE WHEN z >= 0 THEN {Q.erfc_nonneg('abs(z) / sqrt(2.0)')}
                ELSE {Q.erfc_nonneg('abs(z) / sqrt(2.0)')} END AS p
    FROM z2"""


def _flow_long_sql() -> str:
    return f"""
    SELECT vape_user AS grp, sentiment, cnt, sum(cnt) OVER (PARTITION BY vape_user) AS nobs FROM (
      SELECT vape_user, s.sentiment, count(n.sentiment) AS cnt
      FROM (SELECT DISTINCT vape_user FROM ({_named_sql()}) WHERE vape_user IS NOT NULL) g
      CROSS JOIN (SELECT unnest(['Negative', 'Neutral', 'Positive']) AS sentiment) s
      LEFT JOIN ({_named_sql()}) n USING (vape_user, sentiment)
      GROUP BY vape_user, s.sentiment)"""


SQL = {
    "sentiment_by_group_counts": _counts_sql(),
    "sentiment_by_group_share": f"""
      SELECT vape_user,
             {Q.r6('Negative / (Negative + Neutral + Positive)')} AS Negative,
             {Q.r6('Neutral / (Negative + Neutral + Positive)')} AS Neutral,
             {Q.r6('Positive / (Negative + Neutral + Positive)')} AS Positive
      FROM ({_counts_sql()})""",
    "sentiment_by_user_flow": f"""
      SELECT sentiment, count_1, nobs_1, count_2, nobs_2,
             {Q.r6('count_1 / nobs_1')} AS share_1, {Q.r6('count_2 / nobs_2')} AS share_2,
             {Q.r6('z')} AS z, {Q.r6('p')} AS p
      FROM ({_ztest_sql(_flow_long_sql(), 'sentiment')})""",
    "two_prop_ztest": f"""
      SELECT lang, count_1, nobs_1, count_2, nobs_2, {Q.r6('z')} AS z, {Q.r6('p')} AS p FROM ({_ztest_sql('''
        SELECT grp, lang, cnt, sum(cnt) OVER (PARTITION BY grp) AS nobs FROM (
          SELECT g.grp, s.lang, count(x.lang) AS cnt
          FROM (SELECT DISTINCT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS grp FROM labels) g
          CROSS JOIN (SELECT DISTINCT d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL) s
          LEFT JOIN (SELECT CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS grp, d.lang
                     FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x
            ON x.grp = g.grp AND x.lang = s.lang
          GROUP BY g.grp, s.lang)''', 'lang')})""",
    "cohen_kappa": f"""
      WITH t AS (SELECT CAST(quality AS VARCHAR) a, CAST(1 - toxic AS VARCHAR) b FROM labels
                 WHERE quality IS NOT NULL AND toxic IS NOT NULL),
      n AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM t),
      pe AS (SELECT sum(pa * pb) AS pe FROM
              (SELECT a AS k, count(*) * 1.0 / (SELECT n FROM n) AS pa FROM t GROUP BY a) x
              JOIN (SELECT b AS k, count(*) * 1.0 / (SELECT n FROM n) AS pb FROM t GROUP BY b) y USING (k))
      SELECT 'quality_vs_nontoxic' AS label, CAST(n AS BIGINT) AS n_rows, {Q.r6('po')} AS po,
             {Q.r6('pe')} AS pe, {Q.r6('(po - pe) / (1 - pe)')} AS kappa
      FROM n, pe""",
    "rater_agreement": f"""
      WITH a AS (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
      b AS (SELECT doc_id, text, 1 - toxic AS quality, 1 - quality AS toxic FROM a),
      c0 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text, quality, toxic
             FROM b WHERE doc_id % 7 <> 0),
      c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE doc_id % 13 = 0),
      other AS (SELECT 'same' AS pair, * FROM b UNION ALL SELECT 'changed', * FROM c),
      n AS (SELECT pair, doc_id, count(*) AS k FROM other GROUP BY pair, doc_id),
      keys AS (SELECT p.pair, a.doc_id, coalesce(n.k, 0) AS k FROM (SELECT DISTINCT pair FROM other) p CROSS JOIN a
               LEFT JOIN n ON n.pair = p.pair AND n.doc_id = a.doc_id),
      bad AS (SELECT k.pair, sum(CASE WHEN k.k = 1 AND a.text = x.text THEN 0 ELSE greatest(1, k.k) END) AS n_mismatch
              FROM keys k JOIN a ON a.doc_id = k.doc_id
              LEFT JOIN other x ON x.pair = k.pair AND x.doc_id = k.doc_id AND k.k = 1 GROUP BY k.pair),
      t AS (SELECT k.pair, a.quality AS qa, x.quality AS qb, a.toxic AS ta, x.toxic AS tb
            FROM keys k JOIN a ON a.doc_id = k.doc_id JOIN other x ON x.pair = k.pair AND x.doc_id = k.doc_id WHERE k.k = 1),
      l AS (SELECT pair, 'quality' AS label, qa AS a, qb AS b FROM t UNION ALL SELECT pair, 'toxic', ta, tb FROM t),
      m AS (SELECT pair, label, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM l GROUP BY ALL),
      ma AS (SELECT pair, label, a AS v, count(*) AS c FROM l GROUP BY ALL),
      mb AS (SELECT pair, label, b AS v, count(*) AS c FROM l GROUP BY ALL),
      pe AS (SELECT m.pair, m.label, sum(ma.c * mb.c * 1.0 / (m.n * m.n)) AS pe
             FROM m JOIN ma USING (pair, label) JOIN mb USING (pair, label) WHERE ma.v = mb.v GROUP BY ALL)
      SELECT m.pair, m.label, CAST(m.n AS BIGINT) AS n_rows, CAST(bad.n_mismatch AS BIGINT) AS n_mismatch,
             CASE WHEN bad.n_mismatch = 0 THEN {Q.r6('(po - pe) / (1 - pe)')} END AS kappa
      FROM m JOIN pe USING (pair, label) JOIN bad USING (pair)""",
    "drop_null_labels": """
      SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'y' ELSE 'n' END AS vape_user
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IN (0, 1)""",
    "label_row_counts": """
      SELECT 'quality' AS label, count(*) AS n_before, count(*) FILTER (WHERE l.quality IS NULL) AS n_dropped,
             count(l.quality) AS n_after
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "null_profile": """
      SELECT l.quality, count(*) AS n_rows, count(DISTINCT d.source) AS n_sources
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality""",
    "recode_labels": """
      SELECT doc_id,
             CAST(CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END AS INTEGER) AS vape_user,
             CAST(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS sentiment,
             CASE quality + toxic WHEN 0 THEN 'none' WHEN 1 THEN 'one' END AS partial
      FROM labels""",
}

QUERIES = {
    "sentiment_by_group_counts": q_sentiment_by_group_counts,
    "sentiment_by_group_share": q_sentiment_by_group_share,
    "sentiment_by_user_flow": q_sentiment_by_user_flow,
    "two_prop_ztest": q_two_prop_ztest,
    "cohen_kappa": q_cohen_kappa,
    "rater_agreement": q_rater_agreement,
    "drop_null_labels": q_drop_null_labels,
    "label_row_counts": q_label_row_counts,
    "null_profile": q_null_profile,
    "recode_labels": q_recode_labels,
}
