"""DuckDB SQL fragments for the oracle queries.

The oracle is an independent engine; these helpers only spell the shared
constants (regex classes, accent table, word lists) into SQL text so both
sides read the same parameters.  DuckDB strings take backslashes literally.
"""

from __future__ import annotations

from textlab.functions import clean as C
from textlab.functions.wordlists import ENGLISH_STOP_WORDS, LDA_EXTRA_STOP_WORDS, LEMMAS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def r6(expr: str) -> str:
    """Round to 6 digits; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def dbl_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: CAST({float(v)!r} AS DOUBLE)" for k, v in d.items()) + "}"


def str_map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


WS = C.WS
STOP = str_list(sorted(set(ENGLISH_STOP_WORDS)))
STOP_LDA = str_list(sorted(set(ENGLISH_STOP_WORDS + LDA_EXTRA_STOP_WORDS)))
LEMMA_MAP = str_map({w: lem for w, lem, _ in LEMMAS})


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def tokenize(x: str, min_len: int = 2, max_len: int = 15) -> str:
    runs = (f"regexp_extract_all(translate(lower({x}), {q(C.ACCENTED)}, {q(C.PLAIN)}), "
            f"{q(C.ALPHA_RUN)})")
    return (f"list_filter({runs}, lambda t: length(t) >= {min_len} AND length(t) <= {max_len} "
            f"AND NOT starts_with(t, '_'))")


def remove_words(toks: str, words_sql: str) -> str:
    return f"list_filter({toks}, lambda t: NOT list_contains({words_sql}, t))"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda t: t <> '')"


def remove_noise(x: str) -> str:
    c = f"regexp_replace({x}, {q(C.EMAIL_LIKE)}, '', 'g')"
    c = f"regexp_replace({c}, '[{WS}]+', ' ', 'g')"
    c = f"replace({c}, '''', '')"
    c = f"regexp_replace({c}, {q(C.URL_HTTP)}, '', 'g')"
    return f"regexp_replace({c}, {q(C.COMPLEX_NUMBER)}, '', 'g')"


def lda_tokens(x: str) -> str:
    return remove_words(tokenize(remove_noise(x)), STOP_LDA)


def lemmatize(toks: str) -> str:
    return f"list_transform({toks}, lambda t: coalesce({LEMMA_MAP}[t], t))"


def clean_bertopic(x: str) -> str:
    c = f"regexp_replace(lower({x}), {q(C.PUNCT_ALL)}, '', 'g')"
    return f"array_to_string({lemmatize(remove_words(split_ws(c), STOP))}, ' ')"


def clean_tweet(x: str, n: int = 512) -> str:
    c = f"regexp_replace({x}, {q(C.TWEET_URL)}, '', 'g')"
    c = f"regexp_replace({c}, {q(C.EMOJI)}, '', 'g')"
    c = f"regexp_replace({c}, {q(C.SMILEY)}, '', 'g')"
    c = f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"
    return f"substring({c}, 1, {n})"


def mean_valence(toks: str, lexicon: dict) -> str:
    vals = f"list_filter(list_transform({toks}, lambda t: {dbl_map(lexicon)}[t]), lambda v: v IS NOT NULL)"
    return f"(CASE WHEN len({vals}) = 0 THEN 0.0 ELSE list_sum({vals}) / len({vals}) END)"


def score_class(x: str, pos: float = 0.05, neg: float = -0.05) -> str:
    return f"(CASE WHEN {x} > {pos} THEN 1 WHEN {x} < {neg} THEN -1 WHEN {x} IS NOT NULL THEN 0 END)"


def erfc_nonneg(x: str) -> str:
    from textlab.functions.stats_fn import erfc_sql
    return erfc_sql(x)
