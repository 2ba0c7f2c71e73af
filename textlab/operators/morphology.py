"""F15 beyond the word table: lemmas and parts of speech that the corpus itself confirms.

A word that ends like an inflected form is one if the base that its rule gives
occurs as a word too; of several bases the most frequent wins.  A base with both an
-ing and an -ed form is a verb.  Other words go by their derivational suffix, and
what is left counts as a noun.  The rules meet the vocabulary (distinct words with
their counts, joined with itself by word), never the texts: texts are read once to
count and once to apply the table of forms.  There is no tagger, so a word has one part
of speech wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.wordlists import ALLOWED_POS, LEMMAS
from textlab.session import cut_lineage

#: (suffix, what takes its place, part of speech, ending that must occur on the same stem), the preferred first.
#: "~" takes a doubled consonant back; without a part of speech the base's own holds.
INFLECTIONS = [
    ("ies", "y", None, None), ("es", "", None, None), ("s", "", None, None),
    ("ied", "y", "VERB", None), ("ed", "e", "VERB", None), ("ed", "", "VERB", None), ("ed", "~", "VERB", None),
    ("ing", "", "VERB", None), ("ing", "e", "VERB", None), ("ing", "~", "VERB", None),
    ("iest", "y", "ADJ", None), ("ier", "y", "ADJ", "iest"), ("est", "", "ADJ", None), ("er", "", "ADJ", "est"),
    ("est", "e", "ADJ", None), ("er", "e", "ADJ", "est"), ("est", "~", "ADJ", None), ("er", "~", "ADJ", "est"),
]
#: Derivational suffixes; the longest that fits decides.
SUFFIXES = {
    "ADV": ["ly"],
    "ADJ": ["able", "ible", "ful", "less", "ous", "ive", "ish", "ical", "ic", "al", "ary"],
    "VERB": ["ize", "ise", "ify"],
    "NOUN": ["tion", "sion", "ment", "ness", "ity", "ism", "ist", "ance", "ence", "ship", "hood"],
}
#: Letters of a base, and of a stem with a derivational suffix, at least.
SHORTEST = 3
DOUBLED = r"([bdfglmnprt])\1$"
#: Tokens of a block of documents; a longer document is a block of its own.
BLOCK = 1 << 18


def _candidates(word):
    """Every base that a rule gives: array of (base, rule, also)."""
    out = []
    for i, (suffix, end, _, also) in enumerate(INFLECTIONS):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        base, fits = F.concat(stem, F.lit(end)), F.endswith(word, F.lit(suffix))
        if end == "~":
            base, fits = F.substring(stem, F.lit(1), F.length(stem) - 1), fits & stem.rlike(DOUBLED)
        fits = fits & (F.length(base) >= SHORTEST) & base.rlike("[aeiouy]")
        other = F.concat(stem, F.lit(also)) if also else F.lit(None).cast("string")
        out.append(F.when(fits, F.struct(base.alias("base"), F.lit(i).alias("rule"), other.alias("also"))))
    return F.array_compact(F.array(*out))


def suffix_pos(word):
    """Part of speech by the longest derivational suffix; null without one."""
    pairs = sorted(((s, pos) for pos, ss in SUFFIXES.items() for s in ss), key=lambda p: (-len(p[0]), p[0]))
    out = F
    for s, pos in pairs:
        out = out.when(F.endswith(word, F.lit(s)) & (F.length(word) >= len(s) + SHORTEST), F.lit(pos))
    return out


def word_forms(docs: DataFrame, tokens: str, lemmas=LEMMAS) -> DataFrame:
    """(word, n, lemma, pos, known_by) of every distinct word.

    ``known_by`` is table (``lemmas`` wins), inflection, paradigm (the base of an -ing and
    an -ed form), suffix or none (lemma the word itself, NOUN).  Null tokens do not count."""
    words = docs.select(F.explode(tokens).alias("word")).where(F.col("word").isNotNull())
    vocab = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    spark = docs.sparkSession
    fixed = spark.createDataFrame([tuple(r) for r in lemmas], "word string, t_lemma string, t_pos string").dropDuplicates(["word"])

    def of(i):
        return F.element_at(F.array(*[F.lit(r[i]).cast("string") for r in INFLECTIONS]), F.col("rule") + 1)

    made = vocab.select("word", F.explode(_candidates(F.col("word"))).alias("c")).select("word", "c.*")
    made = made.join(vocab.select(F.col("word").alias("base"), F.col("n").alias("base_n")), "base")
    if_other = made.where("also is not null").join(vocab.select(F.col("word").alias("also")), "also", "left_semi")
    made = made.where("also is null").unionByName(if_other)
    best = cut_lineage(made.groupBy("word").agg(F.max_by(F.struct("base", "rule"), F.struct("base_n", -F.col("rule"), "base")).alias("b"))
                       .select("word", "b.base", "b.rule").withColumn("r_pos", of(2))
                       .withColumn("ing", of(0) == "ing"))
    verbs = (best.where(F.col("r_pos") == "VERB").groupBy(F.col("base").alias("verb"))
             .agg(F.bool_or("ing").alias("has_ing"), F.bool_or(~F.col("ing")).alias("has_ed")).where("has_ing and has_ed").select("verb"))
    f = vocab.join(fixed, "word", "left").join(best.drop("ing"), "word", "left")
    f = f.withColumn("stem", F.coalesce("base", "word")).join(verbs, F.col("stem") == F.col("verb"), "left")
    is_verb = F.col("verb").isNotNull()
    by_rule = F.coalesce("r_pos", F.when(is_verb, F.lit("VERB")), suffix_pos(F.col("stem")), F.lit("NOUN"))
    alone = F.coalesce(F.when(is_verb, F.lit("VERB")), suffix_pos(F.col("word")), F.lit("NOUN"))
    known = (F.when(F.col("t_pos").isNotNull(), F.lit("table")).when(F.col("base").isNotNull(), F.lit("inflection"))
              .when(is_verb, F.lit("paradigm")).when(suffix_pos(F.col("word")).isNotNull(), F.lit("suffix")).otherwise(F.lit("none")))
    return f.select("word", "n", F.coalesce("t_lemma", "stem").alias("lemma"),
                    F.coalesce("t_pos", F.when(F.col("base").isNotNull(), by_rule).otherwise(alone)).alias("pos"), known.alias("known_by"))


def _token_blocks(docs: DataFrame, tokens: str, keep: tuple) -> DataFrame:
    """block, at (place in it), ``keep`` and the tokens: consecutive rows of about ``BLOCK`` tokens."""
    def work(batches):
        task, made, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            block = np.empty(b.num_rows, np.int64)
            for i, n in enumerate(lengths):
                if size and size + n > BLOCK:
                    made, size = made + 1, 0
                block[i], size = task + made, size + n
            yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], ["block", *b.schema.names])

    src = docs.select(*keep, F.col(tokens).alias("__t"))
    return src.mapInArrow(work, T.StructType([T.StructField("block", T.LongType()), *src.schema.fields]))


def apply_forms(docs: DataFrame, tokens: str, forms: DataFrame, allowed=ALLOWED_POS, keep: tuple = ("doc_id",), out: str = "lemmas") -> DataFrame:
    """``keep`` columns and the lemmas of the tokens of the ``allowed`` parts of speech, in order.  A word that is not in
    ``forms`` keeps its form and counts as a noun.  Null and empty arrays give an empty one.

    Documents lie in blocks of about ``BLOCK`` tokens.  A block asks for the forms of its distinct words, only those
    that change a word or drop it are sent, and its texts are rewritten in one task: no token is a row of its own."""
    blocks = cut_lineage(_token_blocks(docs, tokens, keep))  # read by the words and by the texts

    def distinct(batches):
        for b in batches:
            words, parent = b.column(1), pc.list_parent_indices(b.column(1)).to_numpy(zero_copy_only=False)
            flat, block = pc.list_flatten(words), b.column(0).to_numpy()[parent]
            for one in np.unique(block):
                own = pc.drop_null(pc.unique(flat.filter(pa.array(block == one))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), one)), own], ["at", "word"])

    other = forms.where(~F.coalesce("pos", F.lit("NOUN")).isin(list(allowed)) | (F.coalesce("lemma", "word") != F.col("word")))
    other = other.select("word", F.when(F.coalesce("pos", F.lit("NOUN")).isin(list(allowed)), F.coalesce("lemma", "word")).alias("lemma"))
    needs = blocks.select("block", "__t").mapInArrow(distinct, "at long, word string").distinct().join(other, "word").select("at", "word", "lemma")
    kept = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    names = list(keep)

    def rewrite(block: pa.Table, changed: pa.Table) -> pa.Table:
        texts = block.column("__t").combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        flat, parent = pc.list_flatten(texts), pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        words = coded.dictionary
        place = pc.index_in(words, value_set=changed.column("word").combine_chunks())  # null: as it is
        said = pc.if_else(place.is_valid(), changed.column("lemma").combine_chunks().take(pc.fill_null(place, 0)), words) if changed.num_rows else words
        lemmas = said.take(coded.indices)
        stays = lemmas.is_valid()
        lemmas, parent = lemmas.filter(stays), parent[stays.to_numpy(zero_copy_only=False)]
        ends = np.searchsorted(parent, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.table([*[block.column(c) for c in names], pa.ListArray.from_arrays(pa.array(ends), lemmas)], [*names, out])

    return blocks.groupBy("block").cogroup(needs.groupBy("at")).applyInArrow(rewrite, kept)
