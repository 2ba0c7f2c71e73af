"""J3, M1 with the lexicon as a table: words, idioms of any length, emoji.

The words of a post meet the first words of the entries; where one matches, the runs of
as many words as such entries have meet the entries.  Both are equi-joins: Spark
broadcasts a table below ``autoBroadcastJoinThreshold``, so no text moves; a larger one
is joined by shuffle, and AQE splits a frequent word.
Only hits go on: they are grouped by the hash of their tokens, so that copies of
a post are one, and a run inside a longer one loses.  Scores come back to the
posts by that hash.  Long posts are handled in pieces of ``PIECE`` words.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.clean import EMOJI, _c, word_table
from textlab.functions.wordlists import BOOSTERS, NEGATIONS
from textlab.operators.lexicon import (ALPHA, BOOST_DISTANCE, BOOST_INCR, BUT_AFTER, BUT_BEFORE, CAPS_INCR, EXCLAIM_INCR,
                                       EXCLAIM_MAX, NEGATION_SCALAR, QUESTION_INCR, QUESTION_MAX, _count_char,
                                       compound_tokens, is_negation, let)
from textlab.session import cut_lineage

PIECE = 4096
#: First words of entries that are looked for inside a post's row; with more of them every word goes to the join.
HEADS = 10_000
#: Words before a hit that its context rules read.
BEFORE = max(BOOST_DISTANCE)
#: "never so good", "never this good" (fixed value of the published rules).
NEVER_SO = 1.25


def describe_emoji(text) -> Column:
    """Every emoji as its Unicode name in lower case, set off by spaces; a text without one stays as it is."""
    names = {chr(c): unicodedata.name(chr(c)).lower()
             for a, b in ((0x2600, 0x27BF), (0x1F300, 0x1FAFF)) for c in range(a, b + 1) if unicodedata.name(chr(c), "")}
    name = word_table({k: f" {v} " for k, v in names.items()})
    t = _c(text)
    said = F.array_join(F.transform(F.split(t, ""), lambda ch: F.coalesce(name(ch), ch)), "")
    return F.when(t.rlike(EMOJI), said).otherwise(t)


def entries(lexicon: DataFrame, phrase: str = "phrase", valence: str = "valence", tokenizer=compound_tokens) -> DataFrame:
    """A lexicon table as (phrase, n_words, valence), one row per phrase.

    Phrases are read as the scorer reads texts (``tokenizer``, lower case).  Of equal
    phrases the strongest valence counts, of equally strong ones the positive.  Rows
    without a word or a number leave."""
    e = lexicon.select(F.transform(tokenizer(F.col(phrase)), F.lower).alias("w"), F.col(valence).cast("double").alias("valence"))
    e = e.where((F.size("w") > 0) & F.col("valence").isNotNull() & ~F.isnan("valence"))
    e = (e.groupBy(F.array_join("w", " ").alias("phrase"))
          .agg(F.first(F.size("w")).alias("n_words"), F.max_by("valence", F.struct(F.abs("valence"), "valence")).alias("valence")))
    return cut_lineage(e)  # read several times, and by its true size the planner knows the smaller side


def _is_caps(t: Column) -> Column:
    return (F.upper(t) == t) & (F.lower(t) != t)


def token_key(tokens) -> Column:
    """Hash of a token array; tokens hold no spaces."""
    return F.md5(F.array_join(_c(tokens), " "))


def phrase_hits(posts: DataFrame, tokens: str, lexicon: DataFrame, carry: tuple = (), before: int = 0) -> DataFrame:
    """Runs of words that are entries: key, pos (from 0), n_words, valence, caps (written in capitals), the ``before``
    words before the run (nearest first) and the columns ``carry``, which must follow from the tokens.

    A run inside a longer entry's run is no hit; runs that only overlap both are.  Posts of equal tokens give one set
    of rows.  ``lexicon`` comes from :func:`entries`.  Null and empty token arrays and an empty lexicon give none."""
    longest = lexicon.agg(F.max("n_words")).first()[0] or 1
    heads = (lexicon.groupBy(F.substring_index("phrase", " ", 1).alias("head"))
                    .agg(F.sort_array(F.collect_set("n_words")).alias("lengths")))
    few = [r["head"] for r in heads.select("head").limit(HEADS + 1).collect()]
    t = F.col(tokens)
    # no filter on the size: it would go below the tokenizer and run it twice
    froms = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(PIECE)))
    src = posts.select(token_key(t).alias("key"), *carry, t.alias("__t"), F.explode(froms).alias("__from"))
    lead = F.least(F.col("__from"), F.lit(before))
    src = src.select("key", *carry, "__from", lead.alias("__lead"),
                     F.slice("__t", F.col("__from") - lead + 1, lead + PIECE + longest - 1).alias("__t"))

    def place(p, i):
        start = F.greatest(i - before, F.lit(0))
        near = [F.reverse(F.slice(p["t"], start + 1, i - start)).alias("before")] if before else []
        return F.struct((p["from"] + i - p["lead"]).cast("int").alias("pos"), F.lower(F.get(p["t"], i)).alias("head"),
                        F.slice(p["t"], i + 1, longest).alias("ahead"), *near)

    def places(p):
        at = F.sequence(p["lead"], F.least(p["lead"] + PIECE, F.size(p["t"])) - 1)
        if 0 < len(few) <= HEADS:  # words that start no entry leave inside the row; the join below finds the same ones
            at = F.filter(at, lambda i: F.lower(F.get(p["t"], i)).isin(few))
        return F.transform(at, lambda i: place(p, i))

    bound = F.struct(F.col("__t").alias("t"), F.col("__from").alias("from"), F.col("__lead").alias("lead"))
    at = src.select("key", *carry, F.explode(let(bound, places)).alias("r")).select("key", *carry, "r.*").join(heads, "head")
    at = at.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.size("ahead"))))
    said = at.withColumn("said", F.array_join(F.slice("ahead", 1, F.col("n")), " ")).withColumn("phrase", F.lower("said"))
    found = said.drop("n", "ahead", "lengths", "head").join(lexicon, "phrase").withColumn("caps", _is_caps(F.col("said")))
    rest = ["valence", "caps", *carry, *(["before"] if before else [])]
    found = found.groupBy("key", "pos", "n_words").agg(*[F.first(c).alias(c) for c in rest])
    earlier = Window.partitionBy("key").orderBy("pos", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n_words")
    return (found.withColumn("__reach", F.max(end).over(earlier))
                 .where(F.coalesce(F.col("__reach"), F.lit(0)) < end).drop("__reach"))


def lexicon_hits_table(posts: DataFrame, tokens: str, lexicon: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_hits, n_idioms (hits of several words) and sum_valence per row of ``posts``."""
    per = (phrase_hits(posts, tokens, lexicon).groupBy("key")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") > 1).alias("i"), F.sum("valence").alias("v")))
    rows = posts.select(*keep, token_key(tokens).alias("key")).join(per, "key", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return rows.select(*keep, zero("n", 0).alias("n_hits"), zero("i", 0).alias("n_idioms"), zero("v", 0.0).alias("sum_valence"))


def _context(k: int, scale: float, boost, neg: list):
    """The effect of the word ``k`` before a hit on its valence: its boost with the
    valence's sign so far, then its negation; none if the word is part of a hit."""
    word = lambda j: F.lower(F.get(F.col("before"), j - 1))
    prev, low = F.get(F.col("before"), k - 1), word(k)

    def step(v):
        up = F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        emph = F.when(v > 0, F.lit(CAPS_INCR)).otherwise(F.lit(-CAPS_INCR))
        caps = F.when(F.col("cap_diff") & _is_caps(prev), emph).otherwise(F.lit(0.0))
        inc = F.coalesce((boost(low) * BOOST_INCR * up + caps) * scale, F.lit(0.0))
        factor = F.when(is_negation(low, neg), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
        if k > 1:  # "never so", "without doubt": the nearer words turn the negation into praise, or lift it
            so = doubt = F.lit(False)
            for j in range(1, k):
                so = so | F.coalesce(word(j).isin("so", "this"), F.lit(False))
                doubt = doubt | F.coalesce(word(j) == "doubt", F.lit(False))
            factor = (F.when((low == "never") & so, F.lit(NEVER_SO)).when((low == "without") & doubt, F.lit(1.0)).otherwise(factor))
        return F.when(low.isNull() | F.col(f"__in{k}"), v).otherwise((v + inc) * factor)
    return step


def lexicon_compound_table(posts: DataFrame, text: str, lexicon: DataFrame, keep: tuple = ("doc_id",),
                           negations=NEGATIONS, boosters: dict = BOOSTERS, name: str = "compound") -> DataFrame:
    """M1 on a lexicon table: ``keep`` columns and the compound score in [-1, 1] of every row of ``posts``.

    The rules are those of :func:`textlab.operators.lexicon.lexicon_compound`; an idiom
    counts as one hit where it starts, and its words have no effect of their own.  "never
    so" or "never this" before a hit strengthens it, "without doubt" does not turn it.
    Without a hit the score is 0, for a null text null."""
    boost = word_table({k: float(v) for k, v in boosters.items()})
    neg = sorted(set(negations))
    src = posts.select(*keep, F.col(text).alias("__raw"), compound_tokens(F.col(text)).alias("__t"))
    n_caps = F.size(F.filter("__t", _is_caps))
    tokens = src.select("__t", ((n_caps > 0) & (n_caps < F.size("__t"))).alias("cap_diff"),
                        F.array_position(F.transform("__t", F.lower), F.lit("but")).cast("int").alias("but_at"))
    hits = phrase_hits(tokens, "__t", lexicon, ("cap_diff", "but_at"), BEFORE)

    # kept runs start and end later than those before them: the last BEFORE of them cover all that a hit reads
    w = Window.partitionBy("key").orderBy("pos")
    for k in BOOST_DISTANCE:
        at, inside = F.col("pos") - k, F.lit(False)
        for j in range(1, BEFORE + 1):
            start, words = F.lag("pos", j).over(w), F.lag("n_words", j).over(w)
            inside = inside | F.coalesce((start <= at) & (start + words > at), F.lit(False))
        hits = hits.withColumn(f"__in{k}", inside)
    sign = F.when(F.col("valence") >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    v = F.col("valence") + F.when(F.col("cap_diff") & F.col("caps"), sign * CAPS_INCR).otherwise(F.lit(0.0))
    for k, scale in BOOST_DISTANCE.items():
        v = let(v, _context(k, scale, boost, neg))
    place, but = F.col("pos") + 1, F.col("but_at")
    weight = (F.when(but == 0, F.lit(1.0)).when(place < but, F.lit(BUT_BEFORE)).when(place > but, F.lit(BUT_AFTER))
               .otherwise(F.lit(1.0)))
    per = hits.select("key", (v * weight).alias("v")).groupBy("key").agg(F.sum("v").alias("__s"))

    raw = F.col("__raw")
    shout = F.least(_count_char(raw, "!"), F.lit(EXCLAIM_MAX)) * EXCLAIM_INCR
    asked = let(_count_char(raw, "?"), lambda n: F.when(n <= 1, F.lit(0.0)).when(n <= 3, n * QUESTION_INCR)
                .otherwise(F.lit(QUESTION_MAX)))
    rows = src.select(*keep, token_key("__t").alias("key"), raw.isNull().alias("__null"), (shout + asked).alias("__emph"))
    s, emph = F.col("__s"), F.col("__emph")
    total = F.when(s > 0, s + emph).when(s < 0, s - emph).otherwise(s)
    score = F.when(F.col("__null"), F.lit(None).cast("double")).when(s.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / F.sqrt(total * total + F.lit(ALPHA)))))
    return rows.join(per, "key", "left").select(*keep, score.alias(name))
