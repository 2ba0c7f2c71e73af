"""Vocabulary, bag of words, bigrams, phrase learning and application
(A13, A14, W3, T1, T2, F15).

Adjacent pairs come from the token array itself (``zip_with`` of the array
and its one-step shift), so no window or shuffle is needed to pair tokens;
counts are plain grouped aggregations with map-side combining.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.clean import _c, lookup
from textlab.functions.wordlists import ALLOWED_POS, LEMMAS
from textlab.operators.lexicon import let
from textlab.session import cut_lineage, drop_table

DELIM = "_"


def adjacent_pairs(tokens) -> Column:
    """array<struct<w1, w2>> of neighbouring tokens."""
    return let(_c(tokens), lambda t: F.filter(
        F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                   lambda a, b: F.struct(a.alias("w1"), b.alias("w2"))),
        lambda p: p["w2"].isNotNull()))


def bag_of_words(tokens) -> Column:
    """A14 per row: ``array<struct<token, n>>`` of the distinct tokens and their
    counts, by sorting a copy of the array and run-length encoding it
    (n log n in the document, no shuffle).  Null tokens, sorted to the front, are left out."""
    def per_doc(s):
        first = lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))
        starts = F.array_compact(F.transform(s, lambda x, i: F.when(x.isNotNull() & first(x, i), i)))
        return let(starts, lambda st: F.transform(st, lambda i, j: F.struct(
            F.get(s, i).alias("token"),
            (F.coalesce(F.get(st, j + 1), F.size(s)) - i).cast("bigint").alias("n"))))
    return let(F.sort_array(_c(tokens)), per_doc)


def doc_bow(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, token, n) -- the document-term counts, computed inside each
    row (a document's tokens are already together), so no shuffle."""
    return (df.select(id_col, F.explode(bag_of_words(tokens)).alias("b"))
              .select(id_col, F.col("b.token").alias("token"), F.col("b.n").alias("n")))


def vocabulary(bow: DataFrame) -> DataFrame:
    """(token, df, cf) from the bag of words: document and corpus frequency."""
    return bow.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def unigram_counts(df: DataFrame, tokens: str) -> DataFrame:
    return df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))


def bigram_counts(df: DataFrame, tokens: str) -> DataFrame:
    """(w1, w2, n) over all documents."""
    return (df.select(F.explode(adjacent_pairs(tokens)).alias("p"))
              .groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
              .agg(F.count(F.lit(1)).alias("n")))


#: Tokens whose pairs are counted, and so shuffled, at once.
SLICE = 1 << 29


def ngram_counts(df: DataFrame, tokens: str) -> list[DataFrame]:
    """(w1, w2, n): every token with the one after it, null at the end of a text, as written tables of
    different pairs.  The counts of a token's rows add up to its own.  Each table is made in one pass and
    one shuffle; there are more than one only beyond ``SLICE`` tokens, so that the shuffles need not be on
    disk at one time."""
    t = F.col(tokens)
    pairs = df.select(F.explode(F.arrays_zip(t.alias("w1"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("w2"))).alias("g")).select("g.w1", "g.w2")
    slices = max(1, -(-(df.agg(F.sum(F.size(tokens).cast("long"))).first()[0] or 0) // SLICE))
    which = F.pmod(F.xxhash64("w1", "w2"), F.lit(slices))
    return [cut_lineage((pairs.where(which == i) if slices > 1 else pairs).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")))
            for i in range(slices)]


def phrase_learn(df: DataFrame, tokens: str, min_count: int = 5, threshold: float = 100.0) -> DataFrame:
    """Bigrams scored ``(n_ab - min_count) / n_a / n_b * V`` with V the
    number of distinct unigrams plus distinct bigrams; a phrase scores above
    ``threshold``.  Returns (w1, w2, n, score, phrase).

    Bigram counts come from one pass over the tokens and are written to the
    checkpoint folder, unigram counts are summed from them; V (a corpus-wide
    scalar) is the row count of both, and the scoring joins read the two tables."""
    tables = ngram_counts(df, tokens)
    counts = reduce(DataFrame.unionAll, tables)
    uni = cut_lineage(counts.groupBy("w1").agg(F.sum("n").alias("c")))
    bigrams = counts.where(F.col("w2").isNotNull())
    vocab_size = uni.count() + bigrams.count()
    cand = bigrams.where(F.col("n") > min_count)
    # AQE picks broadcast or shuffle from the real size of uni
    a = uni.select("w1", F.col("c").alias("n1"))
    b = uni.select(F.col("w1").alias("w2"), F.col("c").alias("n2"))
    scored = cand.join(a, "w1").join(b, "w2").withColumn(
        "score", (F.col("n") - min_count).cast("double") / F.col("n1") / F.col("n2") * F.lit(float(vocab_size)))
    out = cut_lineage(scored.where(F.col("score") > threshold)
                            .select("w1", "w2", "n", "score", F.concat_ws(DELIM, "w1", "w2").alias("phrase")))
    for made in (*tables, uni):
        drop_table(made)
    return out


def _merge_starts(flags: Column) -> Column:
    """Greedy left-to-right merging over a '0'/'1' string of "pair k is a
    phrase": inside every run of 1s the merges start at even offsets, which is
    exactly what a non-overlapping left-to-right rewrite of '11' to '10' gives."""
    return F.regexp_replace(flags, "11", "10")


def _emit(t: Column, starts_expr: Column) -> Column:
    """Output tokens from tokens and the merge-start flags (bound once)."""
    return let(starts_expr, lambda starts: _emit_bound(t, starts))


def _emit_bound(t: Column, starts: Column) -> Column:
    def out(w, i):
        here = F.get(starts, i) == "1"
        before = F.coalesce(F.get(starts, i - 1) == "1", F.lit(False))
        return (F.when(here, F.concat(w, F.lit(DELIM), F.get(t, i + 1)))
                 .when(before, F.lit(None).cast("string"))
                 .otherwise(w))
    return F.filter(F.transform(t, out), lambda x: x.isNotNull())


def apply_phrases(tokens, phrases: list[str]) -> Column:
    """T2 for a bounded phrase set (checked by the caller): one pass per
    document, phrase lookup in a hashed literal set, linear in the text."""
    keys = sorted(set(phrases))
    if not keys:
        return _c(tokens)

    def per_doc(t):
        hit = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                          lambda b, i: F.when(F.concat(F.get(t, i), F.lit(DELIM), b).isin(keys), "1").otherwise("0"))
        starts = F.split(_merge_starts(F.array_join(hit, "")), "")
        return _emit(t, starts)
    return let(_c(tokens), per_doc)


#: Phrases that a task holds at most, and tokens that it merges at once, about.
MOST_PHRASES, TOKENS = 1 << 21, 1 << 20


def merge_phrases(column: pa.Array, phrases: pa.Array, known: pa.Array) -> pa.Array:
    """Greedy left-to-right merging in a column of token lists; rows that are not
    ``known`` stay unmerged, null tokens are left out."""
    flags = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words, ends = column.flatten(), np.cumsum(lengths)
    n = len(words)
    if n:
        joined = pa.concat_arrays([pc.binary_join_element_wise(words.slice(0, n - 1), words.slice(1), DELIM), pa.nulls(1, words.type)])
        hit = flags(pc.is_in(joined, value_set=phrases)) & flags(joined.is_valid()) & np.repeat(flags(known), lengths)
        hit[ends[ends > 0] - 1] = False  # the last token of a text has none after it
        place = np.arange(n)
        first = hit & ~np.r_[False, hit[:-1]]
        starts = hit & ((place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0)
        keep = ~np.r_[False, starts[:-1]] & flags(words.is_valid())
        words = pc.if_else(pa.array(starts), joined, words).filter(pa.array(keep))
        ends = np.r_[0, np.cumsum(keep)][ends]
    offsets = pa.array(np.r_[0, ends].astype(np.int32), pa.int32(), mask=np.r_[~flags(column.is_valid()), False])
    return pa.ListArray.from_arrays(offsets, words)


def apply_phrases_df(df: DataFrame, id_col: str, tokens: str, phrases: DataFrame, out: str = "phrased") -> DataFrame:
    """T2 for any phrase table.  ``id_col`` is unique.

    Up to ``MOST_PHRASES`` phrases go to the tasks, which merge them in whole columns
    of tokens: no token and no text is shuffled.  A larger table, and texts with
    repeated ids, go through :func:`_join_phrases`."""
    keys = phrases.select("phrase").where(F.col("phrase").isNotNull()).distinct()
    if keys.count() > MOST_PHRASES or df.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        return _join_phrases(df, id_col, tokens, keys, out)
    held = keys.toArrow().column("phrase").combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(held)

    def work(batches):
        for b in batches:
            at, ids = (b.schema.get_field_index(c) for c in (tokens, id_col))
            size = np.cumsum(pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // TOKENS)) + 1 if len(size) else []
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, merge_phrases(part.column(at), shared.value, part.column(ids).is_valid())],
                                                 names=[*b.schema.names, out])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(out, df.schema[tokens].dataType)]))


def _join_phrases(df: DataFrame, id_col: str, tokens: str, keys: DataFrame, out: str) -> DataFrame:
    """A join of (doc, position, pair) with the phrases; only the matched positions
    travel back to their document."""
    pairs = df.select(id_col, F.posexplode(adjacent_pairs(tokens)).alias("k", "p"))
    hits = (pairs.select(id_col, "k", F.concat_ws(DELIM, "p.w1", "p.w2").alias("phrase"))
                 .join(keys, "phrase", "left_semi")
                 .groupBy(id_col).agg(F.sort_array(F.collect_list("k")).alias("__starts")))
    j = df.join(hits, id_col, "left")

    def flags(r):
        t, ks = r["t"], r["ks"]
        gaps = F.transform(ks, lambda k, j: F.concat(
            F.repeat(F.lit("0"), k - F.coalesce(F.get(ks, j - 1), F.lit(-1)) - 1), F.lit("1")))
        s = F.array_join(gaps, "")
        return F.concat(s, F.repeat(F.lit("0"), F.greatest(F.size(t) - 1 - F.length(s), F.lit(0))))

    rec = F.struct(F.col(tokens).alias("t"), F.coalesce(F.col("__starts"), F.array().cast("array<int>")).alias("ks"))
    phrased = let(rec, lambda r: _emit(r["t"], F.split(_merge_starts(flags(r)), "")))
    return j.withColumn(out, phrased).drop("__starts")


def lemmatize_pos(tokens, lemmas=LEMMAS, allowed=ALLOWED_POS, default_pos: str = "NOUN") -> Column:
    """F15 re-aimed: lemma and part of speech from a word table; words not in
    the table keep their form and count as ``default_pos``; keep ``allowed``."""
    lem = {w: l for w, l, _ in lemmas}
    pos = {w: p for w, _, p in lemmas}
    tagged = F.transform(_c(tokens), lambda t: F.struct(
        lookup(lem, t, t).alias("lemma"), lookup(pos, t, F.lit(default_pos)).alias("pos")))
    kept = F.filter(tagged, lambda s: s["pos"].isin(list(allowed)))
    return F.transform(kept, lambda s: s["lemma"])
