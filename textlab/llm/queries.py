"""The registered queries of the training-data operators: each applies its
operator with production parameters to the whole intended table and derives the
digest columns from the operator's result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bcr, bpe, bytecnn, fmindex, hnsw, imatch, langid, linededup, orchard, packing, repair, sql, superminhash, warc
from textlab.llm.common import read
from textlab.session import tables_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{tables_dir(spark)}/archives-{uuid.uuid4().hex}"
    return warc.read_archives(spark, warc.write_archives(read(spark, sf_dir, "pages"), folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"), k=3, num=85, den=100, bands=20, rows=5)


def op4_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(langid.bucket("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (langid.bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_grams")


def op5_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), VOCABULARY)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(read(spark, sf_dir, "documents"))


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fmindex.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op8_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bcr.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(langid.bucket("doc_id", 5) != 0)
    return bytecnn.predict(docs, bytecnn.learn(docs, labels)).select(
        "doc_id", (langid.bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_path_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(rows), rows)


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.with_inertia(*orchard.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


QUERIES = {
    "op1_hnsw": op1_hnsw,
    "op2_warc": op2_warc,
    "op3_superminhash": op3_superminhash,
    "op4_bitmask_langid": op4_bitmask_langid,
    "op5_forced_bpe": op5_forced_bpe,
    "op6_imatch": op6_imatch,
    "op7_fm_index": op7_fm_index,
    "op8_column_bwt": op8_column_bwt,
    "op9_best_fit": op9_best_fit,
    "op10_byte_cnn": op10_byte_cnn,
    "op11_line_bloom": op11_line_bloom,
    "op12_path_repair": op12_path_repair,
    "op13_orchard": op13_orchard,
}

SQL: dict[str, str] = {
    "op1_hnsw": sql.OP1,
    "op2_warc": sql.OP2,
    "op3_superminhash": sql.OP3,
    "op7_fm_index": sql.OP7,
    "op8_column_bwt": sql.OP8,
    "op11_line_bloom": sql.OP11,
    "op12_path_repair": sql.OP12,
    "op13_orchard": sql.OP13,
}
