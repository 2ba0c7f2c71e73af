"""Vocabulary, bag-of-words, bigram, phrase and lemma queries (LDA chain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.functions.wordlists import ALLOWED_POS, ENGLISH_STOP_WORDS, LDA_EXTRA_STOP_WORDS, LEMMAS
from textlab.operators import morphology as MO
from textlab.operators import phrases as P
from textlab.plans import sql as Q
from textlab.session import cut_lineage, drop_table
from textlab.sources.posts import load_table


STOP_LDA = ENGLISH_STOP_WORDS + LDA_EXTRA_STOP_WORDS


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _words(spark, sf):
    """Phrase-learning input: noise removed, tokenized (stop words kept)."""
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", C.tokenize(C.remove_noise("text")).alias("toks"))


def _lda_tokens(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", C.lda_tokens("text").alias("toks"))


def q_doc_bow(spark, sf):
    return P.doc_bow(_lda_tokens(spark, sf), "doc_id", "toks")


def q_vocabulary(spark, sf):
    return P.vocabulary(P.doc_bow(_lda_tokens(spark, sf), "doc_id", "toks"))


def q_bigram_counts(spark, sf):
    return P.bigram_counts(_words(spark, sf), "toks")


def q_phrase_learn(spark, sf):
    ph = P.phrase_learn(_words(spark, sf), "toks", min_count=5, threshold=100.0)
    return ph.select("w1", "w2", "n", r6(F.col("score")).alias("score"), "phrase")


def _text(df, col):
    return df.select("doc_id", F.size(col).cast("bigint").alias("n_tokens"), F.array_join(col, " ").alias("text"))


def _phrased(words, stop):
    """Tokens without stop words, phrases learned on all tokens applied."""
    ph = P.phrase_learn(words, "toks", min_count=5, threshold=100.0)
    return P.apply_phrases_df(words.select("doc_id", C.remove_words("toks", stop).alias("toks")), "doc_id", "toks", ph)


def q_phrase_apply(spark, sf):
    """Phrases learned on the noise-free tokens, applied to the same tokens
    without stop words (the LDA chain).  The tokens are computed once: the
    stop-word-free list is a filter of the materialised learning tokens."""
    return _text(_phrased(cut_lineage(_words(spark, sf)), STOP_LDA), "phrased")


def _two_passes(words):
    """T1 twice: phrase tables of the first pass and of the second, which reads
    the phrased tokens and so finds three- and four-word phrases."""
    first = P.phrase_learn(words, "toks", min_count=5, threshold=100.0)
    once = cut_lineage(P.apply_phrases_df(words, "doc_id", "toks", first).select("doc_id", F.col("phrased").alias("toks")))
    second = P.phrase_learn(once, "toks", min_count=5, threshold=100.0)
    drop_table(once)
    return first, second


def q_trigram_learn(spark, sf):
    words = cut_lineage(_words(spark, sf))
    _, second = _two_passes(words)
    drop_table(words)
    return second.select("w1", "w2", "n", r6(F.col("score")).alias("score"), "phrase")


def q_trigram_apply(spark, sf):
    """T2 twice: the first pass's phrases, then the second's, on the tokens
    without stop words."""
    words = cut_lineage(_words(spark, sf))
    first, second = _two_passes(words)
    toks = words.select("doc_id", C.remove_words("toks", STOP_LDA).alias("toks"))
    once = cut_lineage(P.apply_phrases_df(toks, "doc_id", "toks", first).select("doc_id", F.col("phrased").alias("toks")))
    drop_table(words)
    return _text(P.apply_phrases_df(once, "doc_id", "toks", second), "phrased")


def lda_corpus(spark, sf):
    """The LDA chain as one flow: noise removal, tokens, phrases learned on all
    tokens, stop words out, phrases applied, lemmas of the allowed parts of
    speech.  (doc_id, toks)"""
    return _corpus(cut_lineage(_words(spark, sf)))


def _corpus(words):
    phrased = _phrased(words, STOP_LDA)
    return phrased.select("doc_id", P.lemmatize_pos("phrased").alias("toks"))


def written_corpus(spark, sf):
    """:func:`lda_corpus` as a table of its own; the tokens it is made of are deleted."""
    words = cut_lineage(_words(spark, sf))
    out = cut_lineage(_corpus(words))
    drop_table(words)
    return out


def q_lda_corpus(spark, sf):
    return _text(lda_corpus(spark, sf), "toks")


def q_clean_template(spark, sf):
    """The crawl-template chain: punctuation and case, tokens, phrases, stop
    words, lemmas of the allowed parts of speech, tokens of more than 3 letters."""
    d = load_table(spark, sf, "documents").select("doc_id", "text")
    words = cut_lineage(d.select("doc_id", C.tokenize(F.lower(F.regexp_replace("text", C.PUNCT_BASIC, ""))).alias("toks")))
    return _phrased(words, C.ENGLISH_STOP_WORDS).select("doc_id", F.array_join(
        C.keep_longer_than(P.lemmatize_pos("phrased"), 3), " ").alias("full_txt_cleaned"))


def q_lemmatize(spark, sf):
    d = _lda_tokens(spark, sf).select("doc_id", P.lemmatize_pos("toks").alias("lem"))
    return d.select("doc_id", F.size("lem").cast("bigint").alias("n_kept"), F.array_join("lem", " ").alias("lemmas"))


def _forms(spark, sf):
    toks = cut_lineage(_lda_tokens(spark, sf).select("doc_id", "toks"))
    return toks, MO.word_forms(toks, "toks")


def q_word_forms(spark, sf):
    """lemma and part of speech of every word of the corpus."""
    return _forms(spark, sf)[1]


def q_lemmatize_forms(spark, sf):
    """F15 with the corpus's own word forms: the lemmas of the allowed parts of speech."""
    toks, forms = _forms(spark, sf)
    d = MO.apply_forms(toks, "toks", cut_lineage(forms))
    return d.select("doc_id", F.size("lemmas").cast("bigint").alias("n_kept"), F.array_join("lemmas", " ").alias("lemmas"))


# ---------------------------------------------------------------- oracle SQL

_LDA_TOK = f"SELECT doc_id, {Q.lda_tokens('text')} AS toks FROM documents"
_WORDS = f"SELECT doc_id, {Q.tokenize(Q.remove_noise('text'))} AS toks FROM documents"
_BOW = f"""SELECT doc_id, token, count(*) AS n FROM
           (SELECT doc_id, unnest(toks) AS token FROM ({_LDA_TOK})) GROUP BY doc_id, token"""
_POS = """SELECT doc_id, unnest(toks) AS w, unnest(range(len(toks))) AS i FROM ({src})"""


def _bigrams_sql(src: str) -> str:
    pairs = f"SELECT w AS w1, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM ({_POS.format(src=src)})"
    return f"SELECT w1, w2, count(*) AS n FROM ({pairs}) WHERE w2 IS NOT NULL GROUP BY w1, w2"


def _phrases_sql(src: str) -> str:
    return f"""
  WITH uni AS (SELECT w, count(*) AS c FROM ({_POS.format(src=src)}) GROUP BY w),
  bi AS ({_bigrams_sql(src)}),
  v AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS v)
  SELECT bi.w1, bi.w2, bi.n, (bi.n - 5) * 1.0 / a.c / b.c * v.v AS score, bi.w1 || '_' || bi.w2 AS phrase
  FROM bi JOIN uni a ON a.w = bi.w1 JOIN uni b ON b.w = bi.w2, v
  WHERE (bi.n - 5) * 1.0 / a.c / b.c * v.v > 100"""


def _apply_sql(src: str, phrases: str) -> str:
    """(doc_id, toks) with the greedy left-to-right merge, by window functions."""
    return f"""
  WITH src AS ({src}), ph AS ({phrases}),
  pos AS (SELECT doc_id, i, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
          FROM ({_POS.format(src="SELECT * FROM src")})),
  flagged AS (SELECT pos.*, ph.phrase IS NOT NULL AS is_p FROM pos LEFT JOIN ph ON ph.phrase = pos.w || '_' || pos.nxt),
  runs AS (SELECT *, max(CASE WHEN is_p AND NOT coalesce(prev_p, false) THEN i END)
                       OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run_start
           FROM (SELECT *, lag(is_p) OVER (PARTITION BY doc_id ORDER BY i) AS prev_p FROM flagged)),
  starts AS (SELECT *, is_p AND (i - run_start) % 2 = 0 AS ms FROM runs),
  emitted AS (SELECT doc_id, i, CASE WHEN ms THEN w || '_' || nxt
                                     WHEN coalesce(lag(ms) OVER (PARTITION BY doc_id ORDER BY i), false) THEN NULL
                                     ELSE w END AS o FROM starts),
  agg AS (SELECT doc_id, list(o ORDER BY i) FILTER (WHERE o IS NOT NULL) AS toks FROM emitted GROUP BY doc_id)
  SELECT src.doc_id, coalesce(agg.toks, []) AS toks FROM src LEFT JOIN agg ON agg.doc_id = src.doc_id"""


def _text_sql(src: str, name: str = "text", count: bool = True) -> str:
    n = "CAST(len(toks) AS BIGINT) AS n_tokens, " if count else ""
    return f"SELECT doc_id, {n}array_to_string(toks, ' ') AS {name} FROM ({src})"


_BIGRAMS = _bigrams_sql(_WORDS)
_PHRASES = _phrases_sql(_WORDS)
_APPLY = _apply_sql(_LDA_TOK, _PHRASES)
_STEPS = f"""WITH words AS MATERIALIZED ({_WORDS}),
  first AS MATERIALIZED ({_phrases_sql("SELECT * FROM words")}),
  once AS MATERIALIZED ({_apply_sql("SELECT * FROM words", "SELECT * FROM first")}),
  second AS MATERIALIZED ({_phrases_sql("SELECT * FROM once")})"""
_TEMPLATE_WORDS = f"""SELECT doc_id, {Q.tokenize(f"lower(regexp_replace(text, {Q.q(C.PUNCT_BASIC)}, '', 'g'))")} AS toks FROM documents"""

_LEM = Q.str_map({w: l for w, l, _ in LEMMAS})
_POSM = Q.str_map({w: p for w, _, p in LEMMAS})



def lemmas_sql(src: str) -> str:
    return f"""SELECT doc_id, list_transform(list_filter(toks, lambda t: list_contains({Q.str_list(ALLOWED_POS)},
                 coalesce({_POSM}[t], 'NOUN'))), lambda t: coalesce({_LEM}[t], t)) AS toks FROM ({src})"""


SQL = {
    "doc_bow": _BOW,
    "vocabulary": f"SELECT token, count(*) AS df, sum(n)::BIGINT AS cf FROM ({_BOW}) GROUP BY token",
    "bigram_counts": _BIGRAMS,
    "phrase_learn": f"SELECT w1, w2, n, {Q.r6('score')} AS score, phrase FROM ({_PHRASES})",
    "phrase_apply": _text_sql(_APPLY),
    "trigram_learn": f"{_STEPS} SELECT w1, w2, n, {Q.r6('score')} AS score, phrase FROM second",
    "trigram_apply": f"""{_STEPS},
      lda AS MATERIALIZED ({_LDA_TOK}),
      one AS MATERIALIZED ({_apply_sql("SELECT * FROM lda", "SELECT * FROM first")})
      {_text_sql(_apply_sql("SELECT * FROM one", "SELECT * FROM second"))}""",
    "lda_corpus": _text_sql(lemmas_sql(_APPLY)),
    "clean_template": f"""WITH words AS MATERIALIZED ({_TEMPLATE_WORDS})
      {_text_sql(f"""SELECT doc_id, list_filter(toks, lambda t: length(t) > 3) AS toks FROM ({lemmas_sql(_apply_sql(
          f"SELECT doc_id, {Q.remove_words('toks', Q.STOP)} AS toks FROM words", _phrases_sql("SELECT * FROM words")))})""",
          "full_txt_cleaned", count=False)}""",
    "lemmatize": f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_kept, array_to_string(toks, ' ') AS lemmas
                     FROM ({lemmas_sql(_LDA_TOK)})""",
}



def _forms_sql() -> str:
    """CTEs up to ``form``: the rules as a table that every word is held against."""
    cell = lambda x: "NULL" if x is None else Q.q(x)
    rules = ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(MO.INFLECTIONS))
    ends = ", ".join(f"({Q.q(s)}, {Q.q(p)})" for p, ss in MO.SUFFIXES.items() for s in ss)
    table = ", ".join(f"({Q.q(w)}, {Q.q(l)}, {Q.q(p)})" for w, l, p in LEMMAS)
    doubled = " OR ".join(f"stem LIKE '%{c}{c}'" for c in "bdfglmnprt")
    return f"""
      rule(id, suffix, ending, rpos, also) AS (VALUES {rules}), fixed(word, lemma, pos) AS (VALUES {table}),
      deriv(suffix, pos) AS (VALUES {ends}),
      vocab AS (SELECT word, count(*) AS n FROM (SELECT unnest(toks) AS word FROM ({_LDA_TOK})) GROUP BY word),
      fit AS (SELECT word, rule.*, left(word, length(word) - length(suffix)) AS stem FROM vocab JOIN rule ON ends_with(word, suffix)),
      cand AS (SELECT *, CASE WHEN ending = '~' THEN left(stem, length(stem) - 1) ELSE stem || ending END AS base
               FROM fit WHERE ending <> '~' OR {doubled}),
      best AS (SELECT * FROM (SELECT cand.*, row_number() OVER (PARTITION BY cand.word ORDER BY v.n DESC, id) AS k
                              FROM cand JOIN vocab v ON v.word = cand.base
                              WHERE length(base) >= {MO.SHORTEST} AND regexp_matches(base, '[aeiouy]')
                                AND (also IS NULL OR stem || also IN (SELECT word FROM vocab))) WHERE k = 1),
      verb AS (SELECT base FROM best WHERE rpos = 'VERB' GROUP BY base HAVING count(DISTINCT suffix = 'ing') = 2),
      ended AS (SELECT word, arg_max(pos, length(suffix)) AS pos FROM vocab JOIN deriv
                ON ends_with(word, suffix) AND length(word) >= length(suffix) + {MO.SHORTEST} GROUP BY word),
      form AS (SELECT v.word, v.n, coalesce(t.lemma, b.base, v.word) AS lemma,
                      coalesce(t.pos, b.rpos, CASE WHEN verb.base IS NOT NULL THEN 'VERB' END, e.pos, 'NOUN') AS pos,
                      CASE WHEN t.pos IS NOT NULL THEN 'table' WHEN b.base IS NOT NULL THEN 'inflection'
                           WHEN verb.base IS NOT NULL THEN 'paradigm' WHEN e.pos IS NOT NULL THEN 'suffix' ELSE 'none' END AS known_by
               FROM vocab v LEFT JOIN fixed t ON t.word = v.word LEFT JOIN best b ON b.word = v.word
               LEFT JOIN verb ON verb.base = coalesce(b.base, v.word) LEFT JOIN ended e ON e.word = coalesce(b.base, v.word))"""


SQL["word_forms"] = f"WITH {_forms_sql()} SELECT * FROM form"
SQL["lemmatize_forms"] = f"""WITH {_forms_sql()},
    tok AS (SELECT doc_id, unnest(toks) AS word, unnest(range(len(toks))) AS i FROM ({_LDA_TOK})),
    said AS (SELECT doc_id, count(*) AS n_kept, string_agg(lemma, ' ' ORDER BY i) AS lemmas FROM tok JOIN form USING (word)
             WHERE list_contains({Q.str_list(ALLOWED_POS)}, pos) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, coalesce(lemmas, '') AS lemmas FROM documents LEFT JOIN said USING (doc_id)"""

QUERIES = {
    "doc_bow": q_doc_bow,
    "vocabulary": q_vocabulary,
    "bigram_counts": q_bigram_counts,
    "phrase_learn": q_phrase_learn,
    "phrase_apply": q_phrase_apply,
    "trigram_learn": q_trigram_learn,
    "trigram_apply": q_trigram_apply,
    "lda_corpus": q_lda_corpus,
    "clean_template": q_clean_template,
    "lemmatize": q_lemmatize,
    "word_forms": q_word_forms,
    "lemmatize_forms": q_lemmatize_forms,
}
