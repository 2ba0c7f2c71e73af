"""Fitted-model queries (checked by rows and by property tests, not by SQL):
classifiers with stratified cross-validation, batch scoring with a Python
model, LDA and its k sweep, embedding PCA/KMeans, topic merging and the
topic-count sweep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.functions.wordlists import LEXICON
from textlab.operators import classify as K
from textlab.operators import clustering as CL
from textlab.operators import coherence as H
from textlab.operators import density as DE
from textlab.operators import lda as LD
from textlab.operators import lda_vb as VB
from textlab.operators import logistic as LO
from textlab.operators import stats as S
from textlab.operators import svd as SV
from textlab.operators import topics as TP
from textlab.operators.lexicon import signed_score
from textlab.plans import sql as Q
from textlab.plans.topics import topic_docs
from textlab.plans.vocab import _APPLY, lemmas_sql, written_corpus
from textlab.session import cut_lineage, tables_dir
from textlab.sources.posts import load_table


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _labelled(spark, sf):
    return _with_labels(spark, sf, load_table(spark, sf, "documents").select("doc_id", C.tokenize("text").alias("toks")))


def _with_labels(spark, sf, posts):
    """``posts`` (doc_id, toks) that have a row of labels."""
    lab = load_table(spark, sf, "labels")
    senti = F.when(F.col("toxic") == 1, F.lit(0)).when(F.col("quality") == 1, F.lit(2)).otherwise(F.lit(1))
    return posts.join(lab, "doc_id").select("doc_id", "toks", senti.alias("sentiment"), F.col("quality").alias("vape_user"))


def _cv_output(per_fold):
    return per_fold.select("fold", "n", r6(F.col("accuracy")).alias("accuracy"),
                           r6(F.col("weighted_f1")).alias("weighted_f1"))


def q_sentiment_classifier(spark, sf):
    """M5 + M7: 3-class classifier, stratified 10-fold CV (all folds in the same passes), metrics per fold."""
    d = _labelled(spark, sf).withColumnRenamed("sentiment", "label")
    _, per_fold, _ = LO.cross_validate(d, "doc_id", "label", 10)
    return _cv_output(per_fold)


def q_user_classifier(spark, sf):
    """M6 + M7: 2-class classifier, stratified 5-fold CV (all folds in the same passes), metrics per fold."""
    d = _labelled(spark, sf).withColumnRenamed("vape_user", "label")
    _, per_fold, _ = LO.cross_validate(d, "doc_id", "label", 5, binary=True)
    return _cv_output(per_fold)


def q_batch_score(spark, sf):
    """M4: a Python model over Arrow batches of 100 cleaned posts (<= 512 chars)."""
    docs = load_table(spark, sf, "documents").select("doc_id", "text")
    scorer = K.batch_scorer(K.lexicon_model_factory(LEXICON), K.SCORE_TYPE, batch_size=100)
    out = docs.select("doc_id", scorer(C.clean_post("text")).alias("r"))
    return out.select("doc_id", F.col("r.label").alias("label"), r6(F.col("r.score")).alias("score"),
                      r6(signed_score(F.col("r.label"), F.col("r.score"))).alias("signed_score"))


def q_lda_topics(spark, sf):
    """T3 + K2: LDA with k = 5 on the composed corpus, one text line per topic."""
    fit = VB.fit(written_corpus(spark, sf), "doc_id", "toks", [5])
    fit.close()
    return LD.topic_lines(VB.topic_terms(fit, 10))


def q_lda_perplexity(spark, sf):
    """Log perplexity of every pass of the models with 2, 5 and 10 topics, fitted together."""
    fit = VB.fit(written_corpus(spark, sf), "doc_id", "toks", [2, 5, 10])
    fit.close()
    return VB.perplexity_curve(spark, fit).withColumn("log_perplexity", r6("log_perplexity"))


def q_lda_mixtures(spark, sf):
    """Every document's mixture of the model with k = 5."""
    fit = VB.fit(written_corpus(spark, sf), "doc_id", "toks", [5])
    return VB.mixtures(fit, 5).select(F.col("id").alias("doc_id"), "n_tokens", F.transform("mixture", r6).alias("mixture"))


def q_lda_intertopic(spark, sf):
    """T8 on an LDA model with k = 5: prevalence, Jensen-Shannon distances as
    two coordinates and the mean distance of each topic to the others."""
    fit = VB.fit(written_corpus(spark, sf), "doc_id", "toks", [5])
    out = VB.intertopic(spark, fit, 5)
    fit.close()
    return out


def q_lda_sweep(spark, sf):
    """T4 + T9: k = 1..10 with mean c_v and log perplexity, all models in the same
    passes; best and local maxima (T7)."""
    docs = written_corpus(spark, sf)
    curve = LD.lda_sweep(docs, "toks", range(1, 11))
    flags = H.select_best(curve.where(F.col("coherence").isNotNull()), "k", "coherence")
    return curve.join(flags.drop("coherence"), "k", "left")


def q_lda_single_topic(spark, sf):
    """T4/T9 for k = 1, which has a closed form: its ten words and perplexity."""
    terms, perp = LD.corpus_topic(written_corpus(spark, sf), "toks", 10)
    return terms.select("topic", "rank", "word", r6(F.col("weight")).alias("weight"), r6(F.lit(perp)).alias("log_perplexity"))


def q_doc_embedding(spark, sf):
    """B1 + B2: embedding column reduced by PCA to 5 components."""
    emb = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return CL.reduce_dimensions(emb, "embedding", 5).select("vec_id", "reduced")


def q_topic_cluster(spark, sf):
    """KMeans (cosine) into 10 topics; small clusters and far points -> -1."""
    emb = load_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return CL.cluster_topics(emb, "embedding", 10, min_topic_size=10, min_similarity=0.0).select(
        "vec_id", "label", "topic")


def q_topic_density(spark, sf):
    """B2 + B3: embeddings reduced to 5 components, density clusters, outliers -1."""
    emb = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return DE.density_clusters(CL.reduce_dimensions(emb, "embedding", 5), "vec_id", "reduced", m=10, min_size=10).select("vec_id", "topic")


def _reduced_texts(spark, sf, k: int = 5):
    docs = cut_lineage(topic_docs(spark, sf).select("doc_id", "toks"))
    return SV.reduce_texts(docs, "doc_id", "toks", k)


def q_text_embedding_reduced(spark, sf):
    """B1 + B2 on texts: TF-IDF over the whole vocabulary, randomised SVD to 5 directions."""
    out, _ = _reduced_texts(spark, sf)
    return out.select(F.col("id").alias("doc_id"), F.transform("reduced", r6).alias("reduced"))


def q_text_density(spark, sf):
    """B1-B3 on texts: reduced texts, density clusters, outliers -1."""
    out, _ = _reduced_texts(spark, sf)
    return DE.density_clusters(out, "id", "reduced", m=10, min_size=10).select(F.col("id").alias("doc_id"), "topic")


def _doc_clusters(spark, sf, k: int = 20):
    # written first: filters on the tokens would go below the deal of the rows, where one task reads a row group
    docs = cut_lineage(topic_docs(spark, sf).select("doc_id", "text", "toks"))
    emb = CL.tfidf_embedding(docs, "toks")
    return cut_lineage(CL.cluster_topics(emb, "features", k, min_topic_size=5, tokens="toks")
                       .select("doc_id", "text", "toks", "topic"))


def _reachable(docs, targets):
    """The targets that the found topics can be reduced to."""
    n = docs.where(F.col("topic") != -1).select("topic").distinct().count()
    return [t for t in targets if t <= n]


def q_topic_reduce(spark, sf):
    """B7 + B8: 20 clusters merged to 10 topics; topic information table with
    words and texts."""
    docs = _doc_clusters(spark, sf)
    to = _reachable(docs, range(1, 11))
    red = CL.relabel(docs, "topic", CL.reduce_topics(docs, "topic", "toks", to[-1:])[to[-1]]) if to else docs
    top = TP.top_words(TP.ctfidf(red.where(F.col("topic") != -1), "topic", "toks"), "topic", 10)
    return TP.topic_info(red.select("topic", "doc_id", "text"), "topic", "doc_id", "text", top)


def q_topic_merge_path(spark, sf):
    """B7 on fixed topics (20 sources): where each goes at 10 and at 5 topics."""
    docs = cut_lineage(topic_docs(spark, sf).select("doc_id", "topic", "toks"))
    maps = CL.reduce_topics(docs, "topic", "toks", _reachable(docs, [5, 10]))
    rows = [(int(n), int(a), int(b)) for n, m in maps.items() for a, b in m.items() if a != -1]
    return spark.createDataFrame(rows, "n int, topic int, merged int")


def q_topic_sweep(spark, sf):
    """Topic counts 5..10 (one merge path from 20 clusters), c_v each: the
    words of all six models are counted in one pass."""
    docs = _doc_clusters(spark, sf)
    tf = cut_lineage(TP.term_counts(docs.where(F.col("topic") != -1), "topic", "toks"))
    maps, models = CL.reduce_topics(docs, "topic", "toks", _reachable(docs, range(5, 11)), counts=tf), {}
    if maps:  # the tables of all models side by side
        each = F.array(*[F.struct(F.lit(nr).alias("model"), F.try_element_at(C.map_literal(m), F.col("topic")).alias("topic")) for nr, m in maps.items()])
        merged = cut_lineage(tf.select("word", "tf", F.explode(each).alias("m")).groupBy("m.model", "m.topic", "word").agg(F.sum("tf").alias("tf")))
        named = TP.model_ctfidf(merged).select(F.concat_ws(":", "model", "topic").alias("topic"), "word", "weight")
        for name, words in H.collect_topic_words(TP.top_words(named, "topic", 10)).items():
            nr, t = name.split(":")
            models.setdefault(int(nr), {})[int(t)] = words
    cv = {r["model"]: r["c"] for r in H.coherence_sweep(docs, "toks", models).groupBy("model").agg(F.avg("c_v").alias("c")).collect()} if models else {}
    return spark.createDataFrame([(int(nr), cv.get(str(nr))) for nr in sorted(models)], "nr int, c_v_score double")


def q_saved_model_scores(spark, sf):
    """M4 + M8 with saved models: fit a sentiment and a user pipeline, save, load,
    score every post's sentiment, then the user type of the scored posts."""
    # written once: a fit reads its rows several times, each time with all the regular expressions of the tokens
    posts = cut_lineage(load_table(spark, sf, "documents").select("doc_id", C.tokenize("text").alias("toks")))
    d = cut_lineage(_with_labels(spark, sf, posts))
    folder = f"{tables_dir(spark)}/models/{uuid.uuid4().hex}"
    K.save_model(K.fit_all(d.withColumnRenamed("sentiment", "label"), K.text_pipeline("toks", "label")), f"{folder}/sentiment")
    K.save_model(K.fit_all(d.withColumnRenamed("vape_user", "label"), K.text_pipeline("toks", "label", binary=True)), f"{folder}/user")
    first = K.load_model(f"{folder}/sentiment").transform(posts).select(
        "doc_id", "toks", (F.col("prediction").cast("int") - 1).alias("sentiment_score"))
    return K.load_model(f"{folder}/user").transform(first).select(
        "doc_id", "sentiment_score", S.recode(F.col("prediction").cast("int"), {1: "y", 0: "n"}).alias("vape_user"))


def q_two_stage_flow(spark, sf):
    """M8: both saved models' scores, then the group test on them."""
    scored = q_saved_model_scores(spark, sf)
    named = scored.select(S.recode(F.col("vape_user"), S.USER_GROUPS).alias("vape_user"),
                          S.recode(F.col("sentiment_score"), S.SENTIMENT_NAMES).alias("sentiment"))
    z = S.two_prop_ztest(named, "vape_user", "sentiment", ["Negative", "Neutral", "Positive"])
    return z.select("sentiment", "count_1", "nobs_1", "count_2", "nobs_2", r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


# ---------------------------------------------------------------- oracle SQL

_LEX = Q.dbl_map(LEXICON)
_POST = f"substring({Q.collapse_ws('text')}, 1, 512)"

SQL = {
    "batch_score": f"""
      SELECT doc_id, CASE WHEN c >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label, {Q.r6('abs(c)')} AS score, {Q.r6('c')} AS signed_score
      FROM (SELECT doc_id, round(s / sqrt(s * s + 15.0), 9) + 0.0 AS c FROM (
        SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(lower({_POST}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'),
                                                        lambda w: coalesce({_LEX}[w], 0.0))), 0.0) AS s FROM documents))""",
    "lda_single_topic": f"""
      WITH cf AS (SELECT w AS word, count(*) AS cf FROM (SELECT unnest(toks) AS w FROM ({lemmas_sql(_APPLY)})) GROUP BY w),
      t AS (SELECT sum(cf) AS n, count(*) AS v FROM cf),
      w AS (SELECT word, cf, (cf + 1.0) / (n + v) AS weight FROM cf, t)
      SELECT 0 AS topic, CAST(row_number() OVER (ORDER BY cf DESC, word) AS INTEGER) AS rank, word, {Q.r6('weight')} AS weight,
             (SELECT {Q.r6('-sum(cf * ln(weight)) / sum(cf)')} FROM w) AS log_perplexity
      FROM w ORDER BY cf DESC, word LIMIT 10""",
}

QUERIES = {
    "sentiment_classifier": q_sentiment_classifier,
    "user_classifier": q_user_classifier,
    "batch_score": q_batch_score,
    "lda_topics": q_lda_topics,
    "lda_sweep": q_lda_sweep,
    "lda_perplexity": q_lda_perplexity,
    "lda_mixtures": q_lda_mixtures,
    "doc_embedding": q_doc_embedding,
    "topic_cluster": q_topic_cluster,
    "topic_density": q_topic_density,
    "text_embedding_reduced": q_text_embedding_reduced,
    "text_density": q_text_density,
    "topic_reduce": q_topic_reduce,
    "topic_sweep": q_topic_sweep,
    "topic_merge_path": q_topic_merge_path,
    "lda_intertopic": q_lda_intertopic,
    "lda_single_topic": q_lda_single_topic,
    "saved_model_scores": q_saved_model_scores,
    "two_stage_flow": q_two_stage_flow,
}
