"""Cleaning, tokenizing and lexicon-scoring queries over whole ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import clean as C
from textlab.functions.slang import expand_slang
from textlab.functions.wordlists import (BOOSTERS, ENGLISH_STOP_WORDS, IDIOMS, INTENSIFIERS, LEXICON, NEGATIONS,
                                         slang_pairs)
from textlab.operators import lexicon as L
from textlab.operators import lexicon_table as T
from textlab.plans import sql as Q
from textlab.sources.posts import load_table


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _docs(spark, sf):
    return load_table(spark, sf, "documents").select("doc_id", "text")


def q_clean_post(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", C.clean_post("text").alias("post"),
                    F.length(C.collapse_ws("text")).cast("bigint").alias("n_chars"))


def q_clean_tweet(spark, sf):
    return _docs(spark, sf).select("doc_id", C.clean_tweet("text").alias("tweet"))


def q_clean_lda(spark, sf):
    from textlab.functions.wordlists import ENGLISH_STOP_WORDS as SW, LDA_EXTRA_STOP_WORDS as EX
    d = _docs(spark, sf).select("doc_id", C.clean_lda("text").alias("text_clean"))
    # tokens from the cleaned column: the noise regexes run once per post
    d = d.select("doc_id", "text_clean", C.tokenize("text_clean", drop=SW + EX).alias("toks"))
    return d.select("doc_id", "text_clean", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


def q_clean_bertopic(spark, sf):
    return _docs(spark, sf).select("doc_id", C.clean_bertopic("text").alias("processed_text"))


def q_tokenize(spark, sf):
    d = _docs(spark, sf).select("doc_id", C.tokenize("text").alias("toks"))
    return d.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


def q_stopword_filter(spark, sf):
    d = _docs(spark, sf).select("doc_id", C.tokenize("text").alias("toks"))
    d = d.withColumn("kept", C.remove_words("toks", ENGLISH_STOP_WORDS))
    return d.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.size("kept").cast("bigint").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


def q_slang_expand(spark, sf):
    return _docs(spark, sf).select("doc_id", expand_slang("text", "substring").alias("expanded"),
                                   expand_slang("text", "token").alias("expanded_token"))


def q_lexicon_hits(spark, sf):
    d = _docs(spark, sf).select("doc_id", C.tokenize("text").alias("toks"))
    d = d.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"), L.lexicon_hits("toks", LEXICON).alias("h"))
    return d.select("doc_id", "n_tokens", F.col("h.n_hits").alias("n_hits"), r6(F.col("h.sum_valence")).alias("sum_valence"))


def q_lexicon_polarity(spark, sf):
    toks = L.scoring_tokens(expand_slang("text", "substring"))
    return _docs(spark, sf).select("doc_id", r6(L.lexicon_polarity(toks)).alias("polarity"))


def q_lexicon_compound(spark, sf):
    return _docs(spark, sf).select("doc_id", r6(L.lexicon_compound(C.collapse_ws("text"))).alias("compound"))


# ---------------------------------------------------------------- oracle SQL

def _slang_sql(x: str) -> str:
    for k, v in slang_pairs():
        x = f"replace({x}, {Q.q(k)}, {Q.q(v)})"
    return x


def _slang_token_sql(x: str) -> str:
    m = Q.str_map(dict(slang_pairs()))
    return f"array_to_string(list_transform({Q.split_ws(x)}, lambda t: coalesce({m}[t], t)), ' ')"


def _no_apostrophes(x: str) -> str:
    return f"replace(replace({x}, chr(39), ''), chr(8217), '')"


def _lexicon_table(spark, sf):
    """Stand-in lexicon table: the scorer's words and idioms, and the first two, three and five words of
    every benchmark text with a valence from -2 to 2."""
    fixed = spark.createDataFrame([(k, float(v)) for k, v in (LEXICON | IDIOMS).items()], "phrase string, valence double")
    b = load_table(spark, sf, "benchmark").select("item_id", F.split("text", r"\s+").alias("w"))
    heads = [b.select(F.array_join(F.slice("w", 1, n), " ").alias("phrase"), ((F.col("item_id") % 9 - 4) / 2.0).alias("valence"))
             for n in (2, 3, 5)]
    for h in heads:
        fixed = fixed.unionByName(h)
    return fixed


def q_lexicon_table_hits(spark, sf):
    """J3 with words and phrases of a lexicon table."""
    d = _docs(spark, sf).select("doc_id", L.compound_tokens(C.collapse_ws("text")).alias("toks"))
    h = T.lexicon_hits_table(d, "toks", T.entries(_lexicon_table(spark, sf)))
    return h.select("doc_id", "n_hits", "n_idioms", r6(F.col("sum_valence")).alias("sum_valence"))


def q_lexicon_idiom_compound(spark, sf):
    """M1 with words, idioms and phrases of a lexicon table, emoji read as their names."""
    d = _docs(spark, sf).select("doc_id", C.collapse_ws(T.describe_emoji("text")).alias("post"))
    s = T.lexicon_compound_table(d, "post", T.entries(_lexicon_table(spark, sf)))
    return s.select("doc_id", r6(F.col("compound")).alias("compound"))


def _negation_sql(x: str, neg: str) -> str:
    return f"coalesce(list_contains({neg}, {x}) OR contains({x}, 'n''t') OR contains({x}, 'n\u2019t'), false)"


def _polarity_sql(toks: str, scale: float = 0.25) -> str:
    lex = Q.dbl_map({k: v * scale for k, v in LEXICON.items()})
    inten = Q.dbl_map(INTENSIFIERS)
    neg = Q.str_list(sorted(set(NEGATIONS)))
    p1 = f"(CASE WHEN i > 1 THEN {toks}[i - 1] END)"
    p2 = f"(CASE WHEN i > 2 THEN {toks}[i - 2] END)"
    negated = f"({_negation_sql(p1, neg)} OR ({inten}[{p1}] IS NOT NULL AND {_negation_sql(p2, neg)}))"
    each = (f"list_transform({toks}, lambda t, i: {lex}[t] * coalesce({inten}[{p1}], 1.0) * "
            f"CASE WHEN {negated} THEN -0.5 ELSE 1.0 END)")
    vals = f"list_filter({each}, lambda v: v IS NOT NULL)"
    avg = f"(CASE WHEN len({vals}) = 0 THEN 0.0 ELSE list_sum({vals}) / len({vals}) END)"
    return f"greatest(-1.0, least(1.0, {avg}))"


def _compound_from_tokens(tk: str, raw: str) -> str:
    lex = Q.dbl_map(LEXICON)
    boost = Q.dbl_map(BOOSTERS)
    neg = Q.str_list(sorted(set(NEGATIONS)))

    def caps(x):
        return f"(upper({x}) = {x} AND lower({x}) <> {x})"

    capdiff = "cap_diff"
    butpos = "but_pos"
    v0 = f"{lex}[lower(t)]"
    sign = f"(CASE WHEN {v0} >= 0 THEN 1.0 ELSE -1.0 END)"
    v = f"({v0} + CASE WHEN {capdiff} AND {caps('t')} THEN {sign} * {L.CAPS_INCR} ELSE 0.0 END)"
    for k, scale in L.BOOST_DISTANCE.items():
        prev = f"(CASE WHEN i > {k} THEN {tk}[i - {k}] END)"
        low = f"lower({prev})"
        emph = f"CASE WHEN {capdiff} AND {caps(prev)} THEN CASE WHEN v > 0 THEN {L.CAPS_INCR} ELSE -{L.CAPS_INCR} END ELSE 0.0 END"
        inc = f"coalesce(({boost}[{low}] * {L.BOOST_INCR} * CASE WHEN v < 0 THEN -1.0 ELSE 1.0 END + {emph}) * {scale}, 0.0)"
        turned = f"(v + {inc}) * CASE WHEN {_negation_sql(low, neg)} THEN {L.NEGATION_SCALAR} ELSE 1.0 END"
        body = f"CASE WHEN {prev} IS NULL OR {lex}[{low}] IS NOT NULL THEN v ELSE {turned} END"
        v = f"(list_transform([{v}], lambda v: {body}))[1]"
    but = (f"(CASE WHEN {butpos} = 0 THEN 1.0 WHEN i < {butpos} THEN {L.BUT_BEFORE} "
           f"WHEN i > {butpos} THEN {L.BUT_AFTER} ELSE 1.0 END)")
    vals = f"list_filter(list_transform({tk}, lambda t, i: {v} * {but}), lambda x: x IS NOT NULL)"
    s = f"coalesce(list_sum({vals}), 0.0)"
    nex = f"least(length({raw}) - length(replace({raw}, '!', '')), {L.EXCLAIM_MAX}) * {L.EXCLAIM_INCR}"
    nq = f"(length({raw}) - length(replace({raw}, '?', '')))"
    qa = f"(CASE WHEN {nq} <= 1 THEN 0.0 WHEN {nq} <= 3 THEN {nq} * {L.QUESTION_INCR} ELSE {L.QUESTION_MAX} END)"
    s2 = f"(CASE WHEN {s} > 0 THEN {s} + {nex} + {qa} WHEN {s} < 0 THEN {s} - ({nex} + {qa}) ELSE {s} END)"
    comp = f"{s2} / sqrt({s2} * {s2} + {L.ALPHA})"
    return f"(CASE WHEN {raw} IS NULL THEN NULL WHEN len({vals}) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, {comp})) END)"


def _words_sql(raw: str) -> str:
    """Tokens of the compound scorer."""
    bare = f"regexp_replace(t, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')"
    return (f"list_filter(list_transform({Q.split_ws(raw)}, lambda t: CASE WHEN length({bare}) <= 2 THEN t ELSE {bare} END), "
            f"lambda t: length(t) > 1)")


def _entries_sql() -> str:
    """CTEs from the lexicon table to ``kept``: the runs that count, each row with its post's words."""
    fixed = ", ".join(f"({Q.q(k)}, {float(v)!r})" for k, v in (LEXICON | IDIOMS).items())
    heads = " UNION ALL ".join(
        f"SELECT array_to_string(regexp_split_to_array(text, '\\s+')[1:{n}], ' '), (item_id % 9 - 4) / 2.0 FROM benchmark" for n in (2, 3, 5))
    return f"""
      lex(phrase, valence) AS (SELECT phrase, CAST(valence AS DOUBLE) FROM
        (SELECT * FROM (VALUES {fixed}) v(phrase, valence) UNION ALL {heads}) u(phrase, valence)),
      ent AS (SELECT phrase, n, CASE WHEN max(valence) >= -min(valence) THEN max(valence) ELSE min(valence) END AS valence
              FROM (SELECT lower(array_to_string(w, ' ')) AS phrase, len(w) AS n, valence
                    FROM (SELECT {_words_sql('phrase')} AS w, valence FROM lex) WHERE len(w) > 0) GROUP BY phrase, n),
      post AS (SELECT *, len(list_filter(tk, lambda t: upper(t) = t AND lower(t) <> t)) AS n_caps,
                      n_caps > 0 AND n_caps < len(tk) AS cap_diff,
                      coalesce(list_position(list_transform(tk, lambda t: lower(t)), 'but'), 0) AS but_pos
               FROM (SELECT doc_id, raw, {_words_sql('raw')} AS tk
                     FROM (SELECT doc_id, {Q.collapse_ws('text')} AS raw FROM documents))),
      run AS (SELECT doc_id, i, n, array_to_string(tk[i:i + n - 1], ' ') AS said
              FROM (SELECT doc_id, tk, unnest(generate_series(1, len(tk))) AS i FROM post), (SELECT DISTINCT n FROM ent)
              WHERE i + n - 1 <= len(tk)),
      hit AS (SELECT run.*, valence, upper(said) = said AND lower(said) <> said AS caps
              FROM run JOIN ent ON lower(said) = phrase),
      kept AS (SELECT * FROM hit h WHERE NOT EXISTS
               (SELECT 1 FROM hit g WHERE g.doc_id = h.doc_id AND g.i <= h.i AND g.i + g.n >= h.i + h.n AND g.n > h.n))"""


def _idiom_compound_sql() -> str:
    boost, neg = Q.dbl_map(BOOSTERS), Q.str_list(sorted(set(NEGATIONS)))
    v = f"valence + CASE WHEN cap_diff AND caps THEN CASE WHEN valence >= 0 THEN 1.0 ELSE -1.0 END * {L.CAPS_INCR} ELSE 0.0 END"
    word = lambda j: f"lower(CASE WHEN i > {j} THEN tk[i - {j}] END)"
    step = f"SELECT *, {v} AS v0 FROM ctx"
    for k, scale in L.BOOST_DISTANCE.items():
        prev, low, x = f"(CASE WHEN i > {k} THEN tk[i - {k}] END)", word(k), f"v{k - 1}"
        emph = (f"CASE WHEN cap_diff AND upper({prev}) = {prev} AND lower({prev}) <> {prev} "
                f"THEN CASE WHEN {x} > 0 THEN {L.CAPS_INCR} ELSE -{L.CAPS_INCR} END ELSE 0.0 END")
        inc = f"coalesce(({boost}[{low}] * {L.BOOST_INCR} * CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END + {emph}) * {scale}, 0.0)"
        nearer = [word(j) for j in range(1, k)]
        so = " OR ".join(f"coalesce({w} IN ('so', 'this'), false)" for w in nearer) or "false"
        doubt = " OR ".join(f"coalesce({w} = 'doubt', false)" for w in nearer) or "false"
        factor = (f"CASE WHEN {low} = 'never' AND ({so}) THEN {T.NEVER_SO} WHEN {low} = 'without' AND ({doubt}) THEN 1.0 "
                  f"WHEN {_negation_sql(low, neg)} THEN {L.NEGATION_SCALAR} ELSE 1.0 END")
        step = f"SELECT *, CASE WHEN {prev} IS NULL OR in{k} THEN {x} ELSE ({x} + {inc}) * {factor} END AS v{k} FROM ({step})"
    covered = " ".join(f"LEFT JOIN inside c{k} ON c{k}.doc_id = kept.doc_id AND c{k}.q = kept.i - {k}" for k in L.BOOST_DISTANCE)
    flags = ", ".join(f"c{k}.q IS NOT NULL AS in{k}" for k in L.BOOST_DISTANCE)
    but = f"CASE WHEN but_pos = 0 THEN 1.0 WHEN i < but_pos THEN {L.BUT_BEFORE} WHEN i > but_pos THEN {L.BUT_AFTER} ELSE 1.0 END"
    nq = "(length(raw) - length(replace(raw, '?', '')))"
    emph = (f"(least(length(raw) - length(replace(raw, '!', '')), {L.EXCLAIM_MAX}) * {L.EXCLAIM_INCR} + CASE WHEN {nq} <= 1 THEN 0.0 "
            f"WHEN {nq} <= 3 THEN {nq} * {L.QUESTION_INCR} ELSE {L.QUESTION_MAX} END)")
    return f"""WITH {_entries_sql()},
      inside AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS q FROM kept),
      ctx AS (SELECT kept.*, tk, cap_diff, but_pos, {flags} FROM kept JOIN post ON post.doc_id = kept.doc_id {covered}),
      total AS (SELECT doc_id, sum(v{max(L.BOOST_DISTANCE)} * {but}) AS s FROM ({step}) GROUP BY doc_id)
      SELECT doc_id, {Q.r6(f'CASE WHEN raw IS NULL THEN NULL WHEN s IS NULL THEN 0.0 ELSE greatest(-1.0, least(1.0, x / sqrt(x * x + {L.ALPHA}))) END')} AS compound
      FROM (SELECT post.doc_id, raw, s, CASE WHEN s > 0 THEN s + {emph} WHEN s < 0 THEN s - {emph} ELSE s END AS x
            FROM post LEFT JOIN total ON total.doc_id = post.doc_id)"""


_TOK = Q.tokenize("text")

SQL = {
    "clean_post": f"""SELECT doc_id, substring({Q.collapse_ws('text')}, 1, 512) AS post,
                      CAST(length({Q.collapse_ws('text')}) AS BIGINT) AS n_chars FROM documents""",
    "clean_tweet": f"SELECT doc_id, {Q.clean_tweet('text')} AS tweet FROM documents",
    "clean_lda": f"""SELECT doc_id, text_clean, CAST(len(toks) AS BIGINT) AS n_tokens,
                     array_to_string(toks, ' ') AS tokens
                     FROM (SELECT doc_id, {Q.remove_noise('text')} AS text_clean, {Q.lda_tokens('text')} AS toks
                           FROM documents)""",
    "clean_bertopic": f"SELECT doc_id, {Q.clean_bertopic('text')} AS processed_text FROM documents",
    "tokenize": f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens
                    FROM (SELECT doc_id, {_TOK} AS toks FROM documents)""",
    "stopword_filter": f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(kept) AS BIGINT) AS n_kept,
                           array_to_string(kept, ' ') AS kept
                           FROM (SELECT doc_id, toks, {Q.remove_words('toks', Q.STOP)} AS kept
                                 FROM (SELECT doc_id, {_TOK} AS toks FROM documents))""",
    "slang_expand": f"""SELECT doc_id, {_slang_sql('text')} AS expanded, {_slang_token_sql('text')} AS expanded_token
                        FROM documents""",
    "lexicon_hits": f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(vals) AS BIGINT) AS n_hits,
                        {Q.r6('coalesce(list_sum(vals), 0.0)')} AS sum_valence
                        FROM (SELECT doc_id, toks, list_filter(list_transform(toks, lambda t: {Q.dbl_map(LEXICON)}[t]),
                                                               lambda v: v IS NOT NULL) AS vals
                              FROM (SELECT doc_id, {_TOK} AS toks FROM documents))""",
    "lexicon_polarity": f"""SELECT doc_id, {Q.r6(_polarity_sql('toks'))} AS polarity
                            FROM (SELECT doc_id, {Q.tokenize(_no_apostrophes(_slang_sql('text')))} AS toks FROM documents)""",
    "lexicon_table_hits": f"""WITH {_entries_sql()}
      SELECT post.doc_id, CAST(count(kept.i) AS BIGINT) AS n_hits, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS n_idioms,
             {Q.r6('coalesce(sum(valence), 0.0)')} AS sum_valence
      FROM post LEFT JOIN kept ON kept.doc_id = post.doc_id GROUP BY post.doc_id""",
    "lexicon_idiom_compound": _idiom_compound_sql(),
    "lexicon_compound": f"""SELECT doc_id, {Q.r6('compound')} AS compound FROM (
                              SELECT doc_id, {_compound_from_tokens('tk', 'raw')} AS compound FROM (
                                SELECT *, len(list_filter(tk, lambda t: upper(t) = t AND lower(t) <> t)) AS n_caps,
                                       n_caps > 0 AND n_caps < len(tk) AS cap_diff,
                                       coalesce(list_position(list_transform(tk, lambda t: lower(t)), 'but'), 0) AS but_pos
                                FROM (
                                SELECT doc_id, raw, list_filter(list_transform({Q.split_ws('raw')}, lambda t:
                                  CASE WHEN length(regexp_replace(t, '^\\p{{P}}+|\\p{{P}}+$', '', 'g')) <= 2 THEN t
                                       ELSE regexp_replace(t, '^\\p{{P}}+|\\p{{P}}+$', '', 'g') END),
                                  lambda t: length(t) > 1) AS tk
                                FROM (SELECT doc_id, {Q.collapse_ws('text')} AS raw FROM documents))))""",
}

QUERIES = {
    "clean_post": q_clean_post,
    "clean_tweet": q_clean_tweet,
    "clean_lda": q_clean_lda,
    "clean_bertopic": q_clean_bertopic,
    "tokenize": q_tokenize,
    "stopword_filter": q_stopword_filter,
    "slang_expand": q_slang_expand,
    "lexicon_hits": q_lexicon_hits,
    "lexicon_polarity": q_lexicon_polarity,
    "lexicon_compound": q_lexicon_compound,
    "lexicon_table_hits": q_lexicon_table_hits,
    "lexicon_idiom_compound": q_lexicon_idiom_compound,
}
