"""Scoring-output recodes, classifier metrics, folds and the bi-weekly mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions.clean import tokenize
from textlab.functions.dates import TWITTER_SQL_FORMAT, biweek_key, format_twitter_time, parse_twitter_time
from textlab.functions.wordlists import LEXICON
from textlab.operators import lexicon as L
from textlab.operators import metrics as M
from textlab.plans import sql as Q
from textlab.sources.posts import load_table


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _scored_docs(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", L.mean_valence(tokenize("text"), LEXICON).alias("score"))


def q_score_sign(spark, sf):
    """P8-P10, M3 on pseudo model outputs derived from the lexicon score."""
    s = F.col("score")
    label3 = F.when(s > 0.05, "LABEL_2").when(s < -0.05, "LABEL_0").otherwise("LABEL_1")
    label2 = F.when(s > 0, "LABEL_1").otherwise("LABEL_0")
    pn = F.when(s >= 0, "POSITIVE").otherwise("NEGATIVE")
    return _scored_docs(spark, sf).select(
        "doc_id",
        L.label_to_score(label3).alias("sentiment_score"),
        L.label_to_flag(label2).alias("vape_user"),
        r6(L.signed_score(pn, F.abs(s))).alias("signed_score"),
        L.score_to_class(s).alias("sentiment_class"))


def _truth_vs_pred(spark, sf):
    lab = load_table(spark, sf, "labels")
    truth = F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0))
    lab = lab.select("doc_id", truth.alias("label"))
    sc = _scored_docs(spark, sf)
    return sc.join(lab, "doc_id").select(
        "doc_id", "label", L.score_to_class(F.col("score")).alias("pred"))


def q_classification_metrics(spark, sf):
    m = M.classification_metrics(_truth_vs_pred(spark, sf), "label", "pred")
    return m.select("n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("weighted_f1")).alias("weighted_f1"))


def q_stratified_folds(spark, sf):
    lab = load_table(spark, sf, "labels")
    truth = F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 1, F.lit(1)).otherwise(F.lit(0))
    return M.stratified_folds(lab.select("doc_id", truth.alias("label")), "label", "doc_id", 10)


def q_cv_metrics(spark, sf):
    """A10-A12 on fixed predictions, per fold of a stratified 10-fold split."""
    tp = M.stratified_folds(_truth_vs_pred(spark, sf), "label", "doc_id", 10)
    per = M.classification_metrics(tp, "label", "pred", by=["fold"])
    per = M.mean_over_folds(per, ["accuracy", "weighted_f1"])
    return per.select("fold", "n", *[r6(F.col(c)).alias(c) for c in
                                     ("accuracy", "weighted_f1", "mean_accuracy", "mean_weighted_f1")])


def q_biweekly_mean(spark, sf):
    """F14 + A3: time stamps written in the Twitter format, parsed back, keyed
    by bi-week; mean score and count per bi-week."""
    ev = load_table(spark, sf, "events").select("ts", "value")
    ts = parse_twitter_time(format_twitter_time(F.col("ts")))
    g = ev.select(biweek_key(ts).alias("biweek"), "value").groupBy("biweek")
    return g.agg(r6(F.avg("value")).alias("average_sentiment"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- oracle SQL

_SCORED = f"SELECT doc_id, {Q.mean_valence(Q.tokenize('text'), LEXICON)} AS score FROM documents"
_TRUTH = "CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END"
_TVP = f"""SELECT s.doc_id, {_TRUTH} AS label, {Q.score_class('s.score')} AS pred
           FROM ({_SCORED}) s JOIN labels l ON s.doc_id = l.doc_id"""


def _metrics_sql(src: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""
      WITH t AS ({src}),
      cls AS (SELECT DISTINCT {byc}c FROM (SELECT {byc}label AS c FROM t UNION ALL SELECT {byc}pred FROM t)),
      per AS (
        SELECT {', '.join('cls.' + b.strip() for b in by.split(',')) + ',' if by else ''} cls.c,
               count(*) FILTER (WHERE t.label = cls.c) AS support,
               count(*) FILTER (WHERE t.label = cls.c AND t.pred = cls.c) AS tp,
               count(*) FILTER (WHERE t.pred = cls.c AND t.label <> cls.c) AS fp
        FROM cls JOIN t ON {' AND '.join(f't.{b.strip()} = cls.{b.strip()}' for b in by.split(',')) if by else 'TRUE'}
        GROUP BY ALL),
      f AS (SELECT *, CASE WHEN 2 * tp + fp + (support - tp) = 0 THEN 0.0
                           ELSE 2.0 * tp / (2 * tp + fp + (support - tp)) END AS f1 FROM per)
      SELECT {byc}CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy,
             sum(support * f1) / sum(support) AS weighted_f1
      FROM f {g}"""


def _folds_sql(src: str, k: int = 10, seed: int = 42) -> str:
    return f"""SELECT *, CAST((row_number() OVER (PARTITION BY label
                 ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {k} AS INTEGER) AS fold
               FROM ({src})"""


SQL = {
    "score_sign": f"""
      SELECT doc_id,
             CASE WHEN score > 0.05 THEN 1 WHEN score < -0.05 THEN -1 ELSE 0 END AS sentiment_score,
             CASE WHEN score > 0 THEN 'y' ELSE 'n' END AS vape_user,
             {Q.r6('CASE WHEN score >= 0 THEN abs(score) ELSE -abs(score) END')} AS signed_score,
             {Q.score_class('score')} AS sentiment_class
      FROM ({_SCORED})""",
    "classification_metrics": f"""
      SELECT n, {Q.r6('accuracy')} AS accuracy, {Q.r6('weighted_f1')} AS weighted_f1
      FROM ({_metrics_sql(_TVP)})""",
    "stratified_folds": _folds_sql(f"SELECT doc_id, {_TRUTH} AS label FROM labels"),
    "cv_metrics": f"""
      SELECT fold, n, {Q.r6('accuracy')} AS accuracy, {Q.r6('weighted_f1')} AS weighted_f1,
             {Q.r6('avg(accuracy) OVER ()')} AS mean_accuracy, {Q.r6('avg(weighted_f1) OVER ()')} AS mean_weighted_f1
      FROM ({_metrics_sql(_folds_sql(_TVP), 'fold')})""",
    "biweekly_mean": f"""
      SELECT CAST(year(t) AS VARCHAR) || '-' || CAST(weekofyear(t) // 2 AS VARCHAR) AS biweek,
             round(avg(value), 6) + 0.0 AS average_sentiment, count(*) AS n
      FROM (SELECT value, strptime(strftime(ts, '{TWITTER_SQL_FORMAT}'), '{TWITTER_SQL_FORMAT}') AS t
            FROM events)
      GROUP BY 1""",
}

QUERIES = {
    "score_sign": q_score_sign,
    "classification_metrics": q_classification_metrics,
    "stratified_folds": q_stratified_folds,
    "cv_metrics": q_cv_metrics,
    "biweekly_mean": q_biweekly_mean,
}
