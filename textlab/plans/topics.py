"""Topic queries on fixed topics, so every topic
table has an exact oracle; plus assignment to label centroids of
``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.operators import coherence as H
from textlab.operators import topics as TP
from textlab.plans import sql as Q
from textlab.session import cut_lineage
from textlab.sources.posts import load_table

TOP_N = 10
SWEEP = list(range(2, 11))


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def topic_docs(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "source", "text")
    return d.select("doc_id", F.regexp_extract("source", r"\d+", 0).cast("int").alias("topic"),
                    "text", C.lda_tokens("text").alias("toks"))


def _weights(spark, sf):
    return TP.ctfidf(topic_docs(spark, sf), "topic", "toks")


def _top(spark, sf):
    return TP.top_words(_weights(spark, sf), "topic", TOP_N)


def q_ctfidf(spark, sf):
    return _weights(spark, sf).select("topic", "word", "tf", r6(F.col("weight")).alias("weight"))


def q_topic_top_words(spark, sf):
    return _top(spark, sf).select("topic", "rank", "word", r6(F.col("weight")).alias("weight"))


def q_topic_info(spark, sf):
    info = TP.topic_info(topic_docs(spark, sf).select("topic", "doc_id", "text"), "topic", "doc_id", "text", _top(spark, sf))
    return info.select(
        "Topic", "Count", "Name",
        F.concat(F.lit("['"), F.array_join("Representation", "', '"), F.lit("']")).alias("Representation"),
        F.to_json("Representative_Docs").alias("Representative_Docs"))


def q_topic_first_docs(spark, sf):
    return TP.first_docs(topic_docs(spark, sf), "topic", "doc_id", 3)


def q_docs_per_topic(spark, sf):
    """A5/U4: size and hash of each topic's texts joined by a space in the order of the ids."""
    return TP.concat_stats(topic_docs(spark, sf).select("topic", "doc_id", "text"), "topic", "text", "doc_id")


def q_topic_distance(spark, sf):
    w = _weights(spark, sf).select("topic", "word", "weight")
    d = TP.topic_cosine(w, "topic")
    return d.select(F.col("topic_a").cast("int").alias("topic_a"), F.col("topic_b").cast("int").alias("topic_b"),
                    r6(F.col("cosine")).alias("cosine"), r6(F.col("distance")).alias("distance"))


def _materialized_docs(spark, sf):
    """The cleaned token table, written once to the checkpoint folder: the
    coherence queries run several jobs over it (topic words, counts)."""
    return cut_lineage(topic_docs(spark, sf).select("doc_id", "topic", "toks"))


def q_topic_relevance(spark, sf):
    """T8 relevant terms (lambda 0.6): the 10 most relevant words per topic.
    Corpus frequencies are summed from the same (materialised) term counts."""
    from pyspark.sql import Window
    w = _weights(spark, sf)
    cf = w.groupBy("word").agg(F.sum("tf").alias("cf"))
    rel = TP.term_relevance(w.select("topic", "word", "weight"), "topic", cf, 0.6)
    win = Window.partitionBy("topic").orderBy(F.col("relevance").desc(), F.col("word").asc())
    top = rel.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= TOP_N)
    return top.select("topic", F.col("rank").cast("int").alias("rank"), "word", r6(F.col("relevance")).alias("relevance"))


def q_coherence_umass(spark, sf):
    docs = _materialized_docs(spark, sf)
    topics = H.collect_topic_words(TP.top_words(TP.ctfidf(docs, "topic", "toks"), "topic", TOP_N))
    u = H.umass(docs, "toks", topics)
    return u.select(F.col("topic").cast("int").alias("topic"), r6(F.col("umass")).alias("umass"))


def q_coherence_cv(spark, sf):
    docs = _materialized_docs(spark, sf)
    topics = H.collect_topic_words(TP.top_words(TP.ctfidf(docs, "topic", "toks"), "topic", TOP_N))
    cv = H.coherence_cv(docs, "doc_id", "toks", topics)
    return cv.select(F.col("topic").cast("int").alias("topic"), r6(F.col("c_v")).alias("c_v"))


def q_best_k(spark, sf):
    """A15/T7 over a sweep of models k = 2..10 (topic = doc_id mod k): mean
    u_mass per k, best k and local maxima of the curve."""
    base = _materialized_docs(spark, sf).select("doc_id", "toks")
    docs = base.select("toks", *[(F.col("doc_id") % k).cast("int").alias(f"t{k}") for k in SWEEP])
    tf = cut_lineage(TP.model_term_counts(docs, {k: f"t{k}" for k in SWEEP}, "toks"))  # one pass for all models
    named = TP.model_ctfidf(tf).select(F.concat_ws(":", "model", "topic").alias("topic"), "word", "weight")
    topics = H.collect_topic_words(TP.top_words(named, "topic", TOP_N))
    # the words of all models are counted in one pass
    u = H.umass(base, "toks", topics).withColumn("k", F.substring_index("topic", ":", 1).cast("int"))
    curve = u.groupBy("k").agg(F.avg("umass").alias("coherence")).select("k", r6(F.col("coherence")).alias("coherence"))
    return H.select_best(curve, "k", "coherence")


def _assigned(spark, sf):
    emb = load_table(spark, sf, "embeddings")
    labels, mat = TP.collect_centroids(TP.centroids(emb, "label", "embedding"), "label")
    return TP.assign_topics(emb.select("vec_id", "embedding"), "embedding", labels, mat)


def q_topic_assign(spark, sf):
    return _assigned(spark, sf).select("vec_id", "topic", r6(F.col("similarity")).alias("similarity"))


def q_doc_topic_probability(spark, sf):
    return _assigned(spark, sf).select("vec_id", "topic", r6(F.col("probability")).alias("probability"))


def q_doc_topic_vector(spark, sf):
    """The probability of every topic for every vector, one row each."""
    labels, mat = TP.collect_centroids(TP.centroids(load_table(spark, sf, "embeddings"), "label", "embedding"), "label")
    emb = load_table(spark, sf, "embeddings").select("vec_id", "embedding")
    names = F.array(*[F.lit(int(x)) for x in labels])
    long = TP.assign_topics(emb, "embedding", labels, mat).select("vec_id", F.posexplode("probabilities").alias("i", "p"))
    return long.select("vec_id", F.get(names, F.col("i")).alias("topic"), r6(F.col("p")).alias("probability"))


# ---------------------------------------------------------------- oracle SQL

def _base_sql(topic_expr: str = r"CAST(regexp_extract(source, '\d+') AS INTEGER)") -> str:
    return f"SELECT doc_id, {topic_expr} AS topic, text, {Q.lda_tokens('text')} AS toks FROM documents"


def _weights_sql(base: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    join_a = f"JOIN a USING ({by})" if by else ", a"
    return f"""
      WITH base AS ({base}),
      tf AS (SELECT {byc}topic, word, count(*) AS tf FROM (SELECT {byc}topic, unnest(toks) AS word FROM base) GROUP BY ALL),
      tot AS (SELECT {byc}topic, sum(tf) AS class_total FROM tf GROUP BY ALL),
      a AS (SELECT {byc}floor(avg(class_total)) AS avg_tokens FROM tot {'GROUP BY ' + by if by else ''}),
      fr AS (SELECT {byc}word, sum(tf) AS word_total FROM tf GROUP BY ALL)
      SELECT {', '.join('tf.' + b for b in [by] if b) + ', ' if by else ''}tf.topic, tf.word, tf.tf,
             tf.tf / tot.class_total * ln(1 + a.avg_tokens / fr.word_total) AS weight
      FROM tf JOIN tot USING ({byc}topic) JOIN fr USING ({byc}word) {join_a}"""


def _top_sql(weights: str, by: str = "") -> str:
    byc = f"{by}, " if by else ""
    return f"""SELECT * FROM (SELECT {byc}topic, CAST(row_number() OVER (PARTITION BY {byc}topic
                 ORDER BY weight DESC, word ASC) AS INTEGER) AS rank, word, weight FROM ({weights}))
               WHERE rank <= {TOP_N}"""


_W = _weights_sql(_base_sql())
_TOPW = _top_sql(_W)


def _umass_sql(base: str, top: str, by: str = "") -> str:
    on = " AND ".join(f"x.{c} = y.{c}" for c in ([by] if by else []) + ["topic"])
    byc = f"{by}, " if by else ""
    pby = f"p1.{by} = s.{by} AND " if by else ""
    return f"""
      WITH base AS ({base}), tw AS ({top}),
      present AS (SELECT DISTINCT {byc}doc_id, word FROM (SELECT {byc}doc_id, unnest(toks) AS word FROM base)
                  WHERE word IN (SELECT word FROM tw)),
      d1 AS (SELECT {byc}word, count(*) AS d FROM present GROUP BY ALL),
      seg AS (SELECT {'x.' + by + ', ' if by else ''}x.topic, x.word AS wi, y.word AS wj
              FROM tw x JOIN tw y ON {on} AND y.rank < x.rank),
      d2 AS (SELECT {'s.' + by + ', ' if by else ''}s.topic, s.wi, s.wj, count(p2.doc_id) AS dd
             FROM seg s LEFT JOIN present p1 ON {pby}p1.word = s.wi
             LEFT JOIN present p2 ON p2.doc_id = p1.doc_id AND p2.word = s.wj {'AND p2.' + by + ' = s.' + by if by else ''}
             GROUP BY ALL),
      n AS (SELECT count(*) AS n FROM documents)
      SELECT {'d2.' + by + ', ' if by else ''}d2.topic,
             avg(ln((dd / n.n + 1e-12) / (d1.d / n.n))) AS umass
      FROM d2 JOIN d1 ON d1.word = d2.wj {'AND d1.' + by + ' = d2.' + by if by else ''}, n
      GROUP BY ALL"""


_CV = f"""
  WITH base AS ({_base_sql()}), tw AS ({_TOPW}),
  rel AS (SELECT DISTINCT word FROM tw),
  toks AS (SELECT doc_id, toks, len(toks) AS n, greatest(len(toks) - 110, 0) + 1 AS nw FROM base),
  occ AS (SELECT * FROM (SELECT doc_id, nw, unnest(toks) AS w, unnest(range(n)) AS p FROM toks)
          WHERE w IN (SELECT word FROM rel)),
  nwin AS (SELECT sum(nw) AS total FROM (SELECT DISTINCT doc_id, nw FROM occ)),
  win AS (SELECT DISTINCT doc_id, s, w FROM (
            SELECT doc_id, w, unnest(range(greatest(0, p - 109), least(p, nw - 1) + 1)) AS s FROM occ)),
  cnt AS (SELECT w, count(*) AS c FROM win GROUP BY w),
  need AS (SELECT DISTINCT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b
           FROM tw x JOIN tw y ON x.topic = y.topic AND x.word < y.word),
  co AS (SELECT need.a, need.b, count(*) AS co FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.s = y.s
         JOIN need ON need.a = x.w AND need.b = y.w GROUP BY ALL),
  seg AS (SELECT x.topic, x.rank AS i, y.rank AS j, x.word AS wi, y.word AS wj FROM tw x JOIN tw y ON x.topic = y.topic),
  np AS (
    SELECT seg.*, ln((coalesce(CASE WHEN wi = wj THEN ci.c ELSE co.co END, 0) / t.total + 1e-12)
                     / ((ci.c / t.total) * (cj.c / t.total)))
                  / (-ln(coalesce(CASE WHEN wi = wj THEN ci.c ELSE co.co END, 0) / t.total + 1e-12)) AS npmi
    FROM seg JOIN cnt ci ON ci.w = seg.wi JOIN cnt cj ON cj.w = seg.wj
    LEFT JOIN co ON co.a = least(wi, wj) AND co.b = greatest(wi, wj), nwin t),
  vw AS (SELECT topic, j, sum(npmi) AS vw FROM np GROUP BY ALL),
  nw AS (SELECT topic, sqrt(sum(vw * vw)) AS nw FROM vw GROUP BY topic),
  pw AS (SELECT np.topic, np.i, sum(np.npmi * vw.vw) AS dot, sqrt(sum(np.npmi * np.npmi)) AS ni
         FROM np JOIN vw ON vw.topic = np.topic AND vw.j = np.j GROUP BY ALL)
  SELECT pw.topic, {Q.r6('avg(dot / (ni * nw.nw))')} AS c_v FROM pw JOIN nw USING (topic) GROUP BY pw.topic"""

_BEST = f"""
  WITH curve AS (
    SELECT k, {Q.r6('avg(umass)')} AS coherence FROM ({_umass_sql(
        "SELECT k, doc_id, CAST(doc_id % k AS INTEGER) AS topic, toks FROM (" + _base_sql() + ") CROSS JOIN range(2, 11) r(k)",
        _top_sql(_weights_sql("SELECT k, doc_id, CAST(doc_id % k AS INTEGER) AS topic, toks FROM (" + _base_sql()
                              + ") CROSS JOIN range(2, 11) r(k)", "k"), "k"), "k")})
    GROUP BY k)
  SELECT CAST(k AS INTEGER) AS k, coherence,
         k = (SELECT first(k ORDER BY coherence DESC, k ASC) FROM curve) AS is_best,
         coherence >= coalesce(lag(coherence) OVER (ORDER BY k), coherence)
           AND coherence >= coalesce(lead(coherence) OVER (ORDER BY k), coherence) AS is_local_max
  FROM curve"""

_CENT = """
  WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  c AS (SELECT label, list(x ORDER BY i) AS c FROM (
          SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e)
          GROUP BY label, i) GROUP BY label),
  s AS (SELECT e.vec_id, c.label AS topic,
               list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS sim
        FROM e CROSS JOIN c),
  b AS (SELECT vec_id, first(topic ORDER BY sim DESC, topic ASC) AS topic, max(sim) AS smax FROM s GROUP BY vec_id)
  SELECT b.vec_id, b.topic, b.smax AS similarity, 1.0 / sum(exp(s.sim - b.smax)) AS probability
  FROM b JOIN s USING (vec_id) GROUP BY ALL"""

_VECTOR = _CENT[:_CENT.index("  b AS (")].rstrip().rstrip(",") + f"""
  SELECT vec_id, topic, {Q.r6('exp(sim) / sum(exp(sim)) OVER (PARTITION BY vec_id)')} AS probability FROM s"""

SQL = {
    "ctfidf": f"SELECT topic, word, tf, {Q.r6('weight')} AS weight FROM ({_W})",
    "topic_top_words": f"SELECT topic, rank, word, {Q.r6('weight')} AS weight FROM ({_TOPW})",
    "topic_info": f"""
      WITH base AS ({_base_sql()}), tw AS ({_TOPW}),
      cnt AS (SELECT topic, count(*) AS Count FROM base GROUP BY topic),
      rep AS (SELECT topic, list(word ORDER BY rank) AS words FROM tw GROUP BY topic),
      fd AS (SELECT topic, list(text ORDER BY doc_id) AS texts FROM (
               SELECT topic, doc_id, text, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn FROM base)
             WHERE rn <= 3 GROUP BY topic)
      SELECT cnt.topic AS Topic, cnt.Count,
             CAST(cnt.topic AS VARCHAR) || '_' || array_to_string(rep.words[1:5], '_') AS Name,
             '[''' || array_to_string(rep.words, ''', ''') || ''']' AS Representation,
             CAST(to_json(fd.texts) AS VARCHAR) AS Representative_Docs
      FROM cnt LEFT JOIN rep USING (topic) LEFT JOIN fd USING (topic)""",
    "topic_first_docs": f"""
      SELECT topic, CAST(rn AS INTEGER) AS rank, doc_id FROM (
        SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn FROM ({_base_sql()}))
      WHERE rn <= 3""",
    "docs_per_topic": f"""
      SELECT topic, n AS n_docs, CAST(length(s) AS BIGINT) AS n_chars,
             list_reduce(list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT)),
                         lambda h, c: (h * {TP.HASH_BASE} + c) % {TP.HASH_MOD}) AS text_hash
      FROM (SELECT topic, count(*) AS n, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS s FROM ({_base_sql()}) GROUP BY topic)""",
    "topic_distance": f"""
      WITH w AS ({_W}),
      dots AS (SELECT x.topic AS topic_a, y.topic AS topic_b, sum(x.weight * y.weight) AS dot
               FROM w x JOIN w y ON x.word = y.word AND x.topic < y.topic GROUP BY ALL),
      nrm AS (SELECT topic, sqrt(sum(weight * weight)) AS nrm FROM w GROUP BY topic),
      pairs AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM nrm a JOIN nrm b ON a.topic < b.topic)
      SELECT p.topic_a, p.topic_b, {Q.r6('coalesce(dot, 0) / (na.nrm * nb.nrm)')} AS cosine,
             {Q.r6('1 - coalesce(dot, 0) / (na.nrm * nb.nrm)')} AS distance
      FROM pairs p LEFT JOIN dots d USING (topic_a, topic_b)
      JOIN nrm na ON na.topic = p.topic_a JOIN nrm nb ON nb.topic = p.topic_b""",
    "coherence_umass": f"SELECT topic, {Q.r6('umass')} AS umass FROM ({_umass_sql(_base_sql(), _TOPW)})",
    "topic_relevance": f"""
      WITH w AS ({_W}),
      tot AS (SELECT topic, sum(weight) AS tw FROM w GROUP BY topic),
      cf AS (SELECT word, sum(tf) AS cf FROM w GROUP BY word),
      total AS (SELECT sum(cf) AS t FROM cf),
      rel AS (SELECT w.topic, w.word,
                     0.6 * ln(w.weight / tot.tw) + 0.4 * ln((w.weight / tot.tw) / (cf.cf / total.t)) AS relevance
              FROM w JOIN tot USING (topic) JOIN cf USING (word), total)
      SELECT topic, CAST(rank AS INTEGER) AS rank, word, {Q.r6('relevance')} AS relevance FROM (
        SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, word ASC) AS rank FROM rel)
      WHERE rank <= {TOP_N}""",
    "coherence_cv": _CV,
    "best_k": _BEST,
    "topic_assign": f"SELECT vec_id, topic, {Q.r6('similarity')} AS similarity FROM ({_CENT})",
    "doc_topic_vector": _VECTOR,
    "doc_topic_probability": f"SELECT vec_id, topic, {Q.r6('probability')} AS probability FROM ({_CENT})",
}

QUERIES = {
    "ctfidf": q_ctfidf,
    "topic_top_words": q_topic_top_words,
    "topic_info": q_topic_info,
    "topic_first_docs": q_topic_first_docs,
    "docs_per_topic": q_docs_per_topic,
    "topic_distance": q_topic_distance,
    "coherence_umass": q_coherence_umass,
    "topic_relevance": q_topic_relevance,
    "coherence_cv": q_coherence_cv,
    "best_k": q_best_k,
    "topic_assign": q_topic_assign,
    "doc_topic_probability": q_doc_topic_probability,
    "doc_topic_vector": q_doc_topic_vector,
}
