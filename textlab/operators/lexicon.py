"""Lexicon sentiment.

The lexicon join is done per row on the token array: the word table is a
fixed, bounded literal map shipped with the plan (a broadcast without a
join), each document is scored where it sits, and no token is ever exploded
or shuffled.  Context rules (negation, boosters, "but") read neighbouring
tokens with ``get(tokens, i - k)``, which is null outside the array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.clean import WS, _c, let, split_ws, tokenize, word_table
from textlab.functions.wordlists import BOOSTERS, INTENSIFIERS, LEXICON, NEGATIONS

# Fixed values from the rule-based sentiment paper (Hutto & Gilbert 2014).
BOOST_INCR = 0.293
CAPS_INCR = 0.733
NEGATION_SCALAR = -0.74
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAIM_INCR, EXCLAIM_MAX = 0.292, 4
QUESTION_INCR, QUESTION_MAX = 0.18, 0.96
ALPHA = 15.0
BOOST_DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def is_negation(token: Column, negations) -> Column:
    """A negation word, or any word with "n't" (either apostrophe); null: no."""
    return F.coalesce(token.isin(negations) | token.contains("n't") | token.contains("n\u2019t"), F.lit(False))


def scoring_tokens(text) -> Column:
    """F10 tokens for the polarity scorer: apostrophes go first, so that "don't"
    is the token "dont" and not "don"."""
    return tokenize(F.translate(_c(text), "'\u2019", ""))


def lexicon_hits(tokens, lexicon: dict = LEXICON) -> Column:
    """struct(n_hits, sum_valence) of the tokens found in the lexicon."""
    value = word_table({k: float(v) for k, v in lexicon.items()})
    keys = sorted(lexicon)
    # The hashed key set finds the hits first, only they pay for the lookup.
    vals = F.transform(F.filter(_c(tokens), lambda t: t.isin(keys)), value)
    return let(vals, lambda v: F.struct(F.size(v).cast("bigint").alias("n_hits"), _sum(v).alias("sum_valence")))


def mean_valence(tokens, lexicon: dict = LEXICON) -> Column:
    """Mean valence of the matched tokens, 0.0 without a match (the simplest
    scorer; the minimum slice uses it)."""
    return let(lexicon_hits(tokens, lexicon),
               lambda h: F.coalesce(F.try_divide(h["sum_valence"], h["n_hits"]), F.lit(0.0)))


def lexicon_polarity(tokens, lexicon: dict = LEXICON, scale: float = 0.25,
                     negations=NEGATIONS, intensifiers: dict = INTENSIFIERS) -> Column:
    """M2: mean polarity of the matched tokens, clipped to [-1, 1].

    A hit right after an intensifier is multiplied by its factor; a hit after a
    negation word (directly, or with one intensifier in between) is multiplied
    by -0.5.  No hit gives 0.0.  ``scale`` maps lexicon valences to [-1, 1]."""
    lex = word_table({k: float(v) * scale for k, v in lexicon.items()})
    inten = word_table({k: float(v) for k, v in intensifiers.items()})
    neg = sorted(set(negations))

    keys = sorted(lexicon)

    def per_row(toks):
        hits = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: F.get(toks, i).isin(keys))
        vals = F.transform(hits, lambda i: score(toks, F.get(toks, i), i))
        return let(vals, lambda v: F.coalesce(F.try_divide(_sum(v), F.size(v)), F.lit(0.0)))

    def score(toks, t, i):
        v = lex(t)
        p1, p2 = F.get(toks, i - 1), F.get(toks, i - 2)
        f1 = inten(p1)
        negated = is_negation(p1, neg) | (f1.isNotNull() & is_negation(p2, neg))
        return v * F.coalesce(f1, F.lit(1.0)) * F.when(negated, F.lit(-0.5)).otherwise(F.lit(1.0))

    return let(let(_c(tokens), per_row), lambda avg: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), avg)))


def compound_tokens(text) -> Column:
    """Tokens of the compound scorer: whitespace split, punctuation stripped
    from both ends unless that leaves two characters or fewer, one-character
    tokens dropped; case is kept (capitals matter)."""
    def strip(t):
        s = F.regexp_replace(t, r"^\p{P}+|\p{P}+$", "")
        return F.when(F.length(s) <= 2, t).otherwise(s)
    return F.filter(F.transform(split_ws(text), strip), lambda t: F.length(t) > 1)


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def lexicon_compound(text, lexicon: dict = LEXICON, negations=NEGATIONS,
                     boosters: dict = BOOSTERS) -> Column:
    """M1: rule + lexicon compound score in [-1, 1].

    Per matched token: capital emphasis when the text mixes case; then the 3
    preceding tokens, nearest first, each unless it is in the lexicon itself:
    boosters and dampeners add (scaled 1, 0.95, 0.9 by distance), a negation
    multiplies what has come together by -0.74.  Around the first "but" hits
    before count half and hits after one and a half.  The sum gets "!" and "?"
    emphasis and is normalised by s / sqrt(s^2 + 15).  A null text has no score."""
    raw = _c(text)
    lex = word_table({k: float(v) for k, v in lexicon.items()})
    boost = word_table({k: float(v) for k, v in boosters.items()})
    keys = sorted(lexicon)
    neg = sorted(set(negations))

    def is_caps(t):
        return (F.upper(t) == t) & (F.lower(t) != t)

    def with_scalars(toks):
        n_caps = F.size(F.filter(toks, is_caps))
        low = F.transform(toks, lambda t: F.lower(t))
        return F.struct(toks.alias("toks"), low.alias("low"),
                        ((n_caps > 0) & (n_caps < F.size(toks))).alias("cap_diff"),
                        F.array_position(low, F.lit("but")).alias("but_pos"))  # 1-based, 0 if absent

    def context(prev, low_prev, cap_diff, scale):
        """One preceding token: its boost with the valence's sign so far, then its
        negation.  A token that is in the lexicon itself has no such effect."""
        def step(v):
            up = F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
            emph = F.when(v > 0, F.lit(CAPS_INCR)).otherwise(F.lit(-CAPS_INCR))
            caps = F.when(cap_diff & is_caps(prev), emph).otherwise(F.lit(0.0))
            inc = F.coalesce((boost(low_prev) * BOOST_INCR * up + caps) * scale, F.lit(0.0))
            turned = (v + inc) * F.when(is_negation(low_prev, neg), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
            return F.when(low_prev.isNull() | low_prev.isin(keys), v).otherwise(turned)
        return step

    def score(r, t, i):
        toks, low, cap_diff, but_pos = r["toks"], r["low"], r["cap_diff"], r["but_pos"]
        v0 = lex(F.get(low, i))
        sign = F.when(v0 >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        v = v0 + F.when(cap_diff & is_caps(t), sign * CAPS_INCR).otherwise(F.lit(0.0))
        for k, scale in BOOST_DISTANCE.items():
            prev, low_prev = F.get(toks, i - k), F.get(low, i - k)
            v = let(v, context(prev, low_prev, cap_diff, scale))
        but = (F.when(but_pos == 0, F.lit(1.0))
                .when(i + 1 < but_pos, F.lit(BUT_BEFORE))
                .when(i + 1 > but_pos, F.lit(BUT_AFTER))
                .otherwise(F.lit(1.0)))
        return v * but

    def per_row(r):
        hits = F.filter(F.sequence(F.lit(0), F.size(r["toks"]) - 1), lambda i: F.get(r["low"], i).isin(keys))
        vals = F.transform(hits, lambda i: score(r, F.get(r["toks"], i), i))
        return let(vals, lambda v: F.struct(F.size(v).alias("n"), _sum(v).alias("s")))

    def finish(a):
        # a: struct(n, s, emph) bound once; s is read several times below.
        s = a["s"]
        s2 = F.when(s > 0, s + a["emph"]).when(s < 0, s - a["emph"]).otherwise(s)
        return let(s2, lambda v: F.when(a["n"] == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / F.sqrt(v * v + F.lit(ALPHA))))))

    def body(raw):
        agg = let(let(compound_tokens(raw), with_scalars), per_row)
        n_ex = F.least(_count_char(raw, "!"), F.lit(EXCLAIM_MAX)) * EXCLAIM_INCR
        q = let(_count_char(raw, "?"), lambda n_q: F.when(n_q <= 1, F.lit(0.0))
                .when(n_q <= 3, n_q * QUESTION_INCR).otherwise(F.lit(QUESTION_MAX)))
        return let(agg, lambda g: let(F.struct(g["n"].alias("n"), g["s"].alias("s"), (n_ex + q).alias("emph")),
                                      finish))

    return F.when(raw.isNotNull(), let(raw, body))


def score_to_class(score, pos: float = 0.05, neg: float = -0.05) -> Column:
    """M3: score -> -1 / 0 / 1."""
    s = _c(score)
    return (F.when(s > pos, F.lit(1)).when(s < neg, F.lit(-1))
             .when(s.isNotNull(), F.lit(0)))


def label_to_score(label, labels=("LABEL_0", "LABEL_1", "LABEL_2")) -> Column:
    """Model label -> -1 / 0 / 1 (unknown label -> null)."""
    l = _c(label)
    return F.when(l == labels[0], F.lit(-1)).when(l == labels[1], F.lit(0)).when(l == labels[2], F.lit(1))


def label_to_flag(label, labels=("LABEL_0", "LABEL_1")) -> Column:
    """Model label -> n / y."""
    l = _c(label)
    return F.when(l == labels[0], F.lit("n")).when(l == labels[1], F.lit("y"))


def signed_score(label, score, positive: str = "POSITIVE") -> Column:
    """P10: +score for the positive label, -score otherwise."""
    return F.when(_c(label) == positive, _c(score)).otherwise(-_c(score))


__all__ = ["is_negation", "scoring_tokens", "lexicon_hits", "mean_valence", "lexicon_polarity", "lexicon_compound", "score_to_class",
           "label_to_score", "label_to_flag", "signed_score", "compound_tokens", "WS"]
