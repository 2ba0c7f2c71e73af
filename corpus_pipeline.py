"""A training-data pipeline of the operators in ``textlab.llm``.

Stages, each on all that the one before kept: quality classifier (rejected
documents go), language identification (rejected documents go), near-duplicates
(one document of each group stays), repeated passages (their words go), packing
into sequences.  All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bytecnn, fmindex, langid, packing, superminhash
from textlab.llm.common import cut_lineage, read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is of no language that was learned if it has this many n-grams and a lower score.
MIN_GRAMS, MIN_SCORE = 40, 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not reject.
    Where no label is to be had nothing is rejected."""
    labels = read(spark, sf_dir, "labels").where(langid.bucket("doc_id", 5) != 0)
    model = bytecnn.learn(docs, labels)
    return bytecnn.predict(docs, model).where("predicted = 1").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned: those without a letter, and
    longer ones that no language's n-grams cover, go."""
    model = langid.learn(docs.where(langid.bucket("doc_id", 3) != 1))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN)
                       & ((F.col("n_grams") < MIN_GRAMS) | (F.col("score") >= MIN_SCORE))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group at a similarity of 0.8 or
    more over five-word shingles, and of that id the text with the smallest hash;
    rows that repeat an id and its text count as one.  Documents without an id link
    with nothing and stay."""
    kept = superminhash.representatives(docs, k=5, num=80, den=100)
    named = (docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"])
             .dropDuplicates(["doc_id", "text_hash"]))
    return named.select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of any 35-word sequence that also starts elsewhere;
    n_chars follows the new text.  Clean documents stay as they are."""
    out = fmindex.remove_repeats(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 2048 tokens at most."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("sequences", sequences),
]

#: A trained network, n-gram filters, tokens and packing: SQL expresses none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's rows written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
