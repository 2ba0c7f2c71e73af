"""Text cleaning and tokenizing as pure Column expressions.

Everything here is a ``Column -> Column`` function built from Spark SQL
built-ins, so it runs inside whole-stage code generation on the executors,
works on batch and streaming DataFrames alike and needs no Python worker.

Regular expressions are written with explicit Unicode classes: Python's
``\\w``/``\\s`` are Unicode-aware, Java's and RE2's are ASCII-only, so the
classes below spell out what the reference's Python patterns match.  The same
pattern text is valid in Java (Spark) and RE2 (DuckDB, used as the oracle).
"""

from __future__ import annotations

import json
import unicodedata
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.wordlists import ENGLISH_STOP_WORDS, LDA_EXTRA_STOP_WORDS, LEMMAS

# Python's Unicode whitespace: ASCII controls, separators 1C-1F, NEL and the Z category.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
# Python's Unicode word characters: letters, all numbers, underscore.
WORD = r"\p{L}\p{N}_"
# Letters without decimal digits: a token of the gensim-style tokenizer.
ALPHA_RUN = r"[\p{L}\p{Nl}\p{No}_]+"

EMAIL_LIKE = rf"[^{WS}]*@[^{WS}]*[{WS}]?"
URL_HTTP = rf"http[^{WS}]+"
COMPLEX_NUMBER = rf"(\p{{Nd}}+\.?\p{{Nd}}*[{WS}]*\+[{WS}]*\p{{Nd}}+\.?\p{{Nd}}*j)"
PUNCT_ALL = rf"[^{WORD}{WS}]"
PUNCT_BASIC = r"[,.!?]"
# Tweet cleaning (our own patterns): links, pictographs, text smileys.
TWEET_URL = rf"(?:https?://|www\.)[^{WS}]+"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"
SMILEY = r"(?:<3|[:;=][-']?[()\[\]DPOSdpos/|]+)"
PROFILE_IMAGE_SUFFIX = r"_normal(\.[A-Za-z]+)?$"


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived by rule: NFD
    decomposition with combining marks dropped (what ``deacc=True`` does)."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_table()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, fn) -> Column:
    """Bind ``value`` once per row and use it in ``fn``.  Inside a lambda an
    outer *expression* is re-evaluated for every array element; a lambda
    variable is not, so this keeps per-token rules linear in the text."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def collapse_ws(col) -> Column:
    """every whitespace run becomes one space."""
    return F.regexp_replace(_c(col), f"[{WS}]+", " ")


def truncate_chars(col, n: int = 512) -> Column:
    """K4: first ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


def clean_post(col, n: int = 512) -> Column:
    """Input of the model scorers: collapse whitespace, keep ``n`` characters."""
    return truncate_chars(collapse_ws(col), n)


def _guarded(c: Column, needles: tuple[str, ...], pattern: str) -> Column:
    """``regexp_replace`` only on texts that can match: a plain substring test
    skips the regex engine for most rows; the result is the same."""
    cond = None
    for n in needles:
        t = c.contains(n)
        cond = t if cond is None else cond & t
    return F.when(cond, F.regexp_replace(c, pattern, "")).otherwise(c)


def remove_noise(col) -> Column:
    """LDA chain (F4, F5, F6, F7, F8) in the reference's order.  Every step reads the one before
    several times, so each is bound once: unbound, the whitespace pass ran up to six times a text."""
    def step(needles, pattern):
        return lambda c: _guarded(c, needles, pattern)
    c = let(_c(col), step(("@",), EMAIL_LIKE))
    c = F.regexp_replace(c, f"[{WS}]+", " ")
    c = F.replace(c, F.lit("'"), F.lit(""))
    c = let(c, step(("http",), URL_HTTP))
    return let(c, step(("+", "j"), COMPLEX_NUMBER))


def clean_tweet(col, n: int = 512) -> Column:
    """drop links, pictographs and smileys, tidy spaces, keep ``n`` chars."""
    c = F.regexp_replace(_c(col), TWEET_URL, "")
    c = F.regexp_replace(c, EMOJI, "")
    c = F.regexp_replace(c, SMILEY, "")
    c = F.trim(F.regexp_replace(c, f"[{WS}]+", " "))
    return truncate_chars(c, n)


def deaccent(col) -> Column:
    return F.translate(_c(col), ACCENTED, PLAIN)


def tokenize(col, min_len: int = 2, max_len: int = 15, drop=None) -> Column:
    """lower-case, strip accents, alphabetic runs, length filter, no
    leading underscore; ``drop`` (stop words) is applied in the same pass over
    the array.  Returns ``array<string>``."""
    runs = F.regexp_extract_all(deaccent(F.lower(_c(col))), F.lit(ALPHA_RUN), 0)
    stop = sorted(set(drop)) if drop else None

    def keep(t):
        k = (F.length(t) >= min_len) & (F.length(t) <= max_len) & ~t.startswith("_")
        return k & ~t.isin(stop) if stop else k
    return F.filter(runs, keep)


def split_ws(col) -> Column:
    """F11 split: whitespace runs, no empty pieces (Python ``str.split()``)."""
    return F.filter(F.split(_c(col), f"[{WS}]+"), lambda t: t != "")


def remove_words(tokens, words) -> Column:
    """J4 as an array filter: keeps duplicates and order (``array_except`` would not).
    ``words`` is a fixed list; ``isin`` is planned as a hashed set (InSet)."""
    words = sorted(set(words))
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def keep_longer_than(tokens, n: int = 3) -> Column:
    """tokens with more than ``n`` characters."""
    return F.filter(_c(tokens), lambda t: F.length(t) > n)


def map_literal(mapping: dict) -> Column:
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def word_table(mapping: dict):
    """A fixed word table as a function Column -> Column (null for other words).
    Spark searches a literal map from end to end, so the words are dealt to
    small maps by their crc32, which both sides can compute: a lookup costs the
    same for 50 words and for 50,000."""
    n = max(1, len(mapping) // 4)
    parts: list[dict] = [{} for _ in range(n)]
    for word, value in mapping.items():
        parts[zlib.crc32(word.encode()) % n][word] = value
    kind = "string" if all(isinstance(v, str) for v in mapping.values()) else "double"
    # one JSON literal, which the optimizer folds into the table itself
    maps = F.from_json(F.lit(json.dumps(parts)), f"array<map<string,{kind}>>")
    return lambda key: F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Value of ``key`` in a fixed table; the hashed key set (InSet) answers the
    common miss first."""
    val = F.when(key.isin(sorted(mapping)), word_table(mapping)(key))
    return val if default is None else F.coalesce(val, default)


def lemmatize_tokens(tokens, lemmas=LEMMAS) -> Column:
    """F15 (form only): replace a token by its lemma when the table has one."""
    m = {w: lem for w, lem, _ in lemmas}
    return F.transform(_c(tokens), lambda t: lookup(m, t, t))


def clean_lda(col) -> Column:
    """Cleaned text of the LDA chain (before tokenizing)."""
    return remove_noise(col)


def lda_tokens(col) -> Column:
    """LDA chain tokens: noise removal, tokenizing, stop words (+5 extras)."""
    return tokenize(remove_noise(col), drop=ENGLISH_STOP_WORDS + LDA_EXTRA_STOP_WORDS)


def clean_bertopic(col, lemmas=LEMMAS) -> Column:
    """Lower, drop punctuation, split, drop stop words,
    lemmatize, re-join with single spaces."""
    c = F.regexp_replace(F.lower(_c(col)), PUNCT_ALL, "")
    stop = sorted(set(ENGLISH_STOP_WORDS))
    toks = F.filter(F.split(c, f"[{WS}]+"), lambda t: (t != "") & ~t.isin(stop))
    return F.array_join(lemmatize_tokens(toks, lemmas), " ")


def strip_normal(col) -> Column:
    """Profile-image URL without the ``_normal`` size suffix."""
    return F.regexp_replace(_c(col), PROFILE_IMAGE_SUFFIX, "$1")


def is_retweet(col, prefix: str = "RT @") -> Column:
    """P4."""
    return _c(col).startswith(prefix)
