"""A4 over crawls that arrive one after the other: first record and count per key.

A crawl is reduced to one row per key (its first record and its count), which is
all a later merge needs: the smaller first record stays, counts add up.  A state
folder holds such parts and manifests that name the live ones; adding a crawl
writes one part of the crawl's size, whatever the state's.  Renaming a new manifest
into place commits it, so a stopped run leaves nothing that counts, and a crawl
that is in the manifest is not added twice.  :func:`compact` merges all parts to one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.ingest import rank_key


def partial_state(df: DataFrame, key: str, record_id: str, seconds: str | None = None) -> DataFrame:
    """(key, rank, row, n): the first record of each key by time and id, as a struct of the other columns, and its count.
    Of records that tie the smallest by its other columns stays; rows without a key are left out."""
    others = [c for c in df.columns if c != key]
    d = df.where(F.col(key).isNotNull()).withColumn("__rank", rank_key(F.col(seconds) if seconds else None, F.col(record_id).cast("string")))
    first = d.groupBy(key).agg(F.min("__rank").alias("__rank"), F.count(F.lit(1)).alias("n"))
    rows = d.join(first, [key, "__rank"]).groupBy(key).agg(F.first("__rank").alias("rank"), F.min(F.struct(*others)).alias("row"), F.first("n").alias("n"))
    return rows.select(F.col(key).alias("key"), "rank", "row", "n")


def merge_states(parts: DataFrame) -> DataFrame:
    """Parts (each one row per key) to one row per key."""
    best = parts.groupBy("key").agg(F.min(F.struct("rank", "row")).alias("b"), F.sum("n").alias("n"))
    return best.select("key", "b.rank", "b.row", "n")


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the newest manifest; (0, nothing) for a new folder."""
    hadoop, fs = _fs(spark, path)
    if not fs.exists(hadoop(path)):
        return 0, {"crawls": [], "parts": []}
    names = [f.getPath().getName() for f in fs.listStatus(hadoop(path))]
    numbers = [int(n[len("manifest-"):]) for n in names if n.startswith("manifest-")]
    if not numbers:
        return 0, {"crawls": [], "parts": []}
    return max(numbers), json.loads(spark.read.text(f"{path}/manifest-{max(numbers)}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    hadoop, fs = _fs(spark, path)
    tmp, done = hadoop(f"{path}/_manifest-{uuid.uuid4().hex}"), hadoop(f"{path}/manifest-{number}")
    out = fs.create(tmp)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(done) or not fs.rename(tmp, done):
        raise RuntimeError(f"{done.toString()} could not be committed: another writer was there")


def add_crawl(df: DataFrame, path: str, crawl: str, key: str, record_id: str, seconds: str | None = None) -> bool:
    """Add a crawl to the state; False if it is there already.  One writer at a time (of two the later one fails).
    Crawls of one state have the same columns."""
    spark = df.sparkSession
    number, m = _manifest(spark, path)
    if crawl in m["crawls"]:
        return False
    part = f"part-{uuid.uuid4().hex}"
    partial_state(df, key, record_id, seconds).write.parquet(f"{path}/{part}")
    _commit(spark, path, number + 1, {"crawls": [*m["crawls"], crawl], "parts": [*m["parts"], part]})
    return True


def _parts(spark: SparkSession, path: str, m: dict) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{p}" for p in m["parts"]])


def compact(spark: SparkSession, path: str) -> None:
    """Merge the live parts to one.  The old parts stay for readers that have opened them; :func:`drop_old` deletes them."""
    number, m = _manifest(spark, path)
    if len(m["parts"]) > 1:
        part = f"part-{uuid.uuid4().hex}"
        merge_states(_parts(spark, path, m)).write.parquet(f"{path}/{part}")
        _commit(spark, path, number + 1, {"crawls": m["crawls"], "parts": [part]})


def drop_old(spark: SparkSession, path: str) -> None:
    """Delete the parts and manifests that the newest manifest does not need, and those of stopped runs."""
    hadoop, fs = _fs(spark, path)
    number, m = _manifest(spark, path)
    live = {*m["parts"], f"manifest-{number}"}
    for f in fs.listStatus(hadoop(path)):
        if f.getPath().getName() not in live:
            fs.delete(f.getPath(), True)


def first_and_count_state(spark: SparkSession, path: str, key: str, count_name: str = "n") -> DataFrame:
    """The state as :func:`textlab.operators.ingest.first_and_count` returns it for all crawls at once."""
    _, m = _manifest(spark, path)
    if not m["parts"]:
        raise ValueError(f"no crawl in {path}")
    s = merge_states(_parts(spark, path, m))
    others = [c for c in s.schema["row"].dataType.names if c != key]
    return s.select(F.col("key").alias(key), *[F.col("row")[c].alias(c) for c in others], F.col("n").alias(count_name))


def stream_crawls(stream: DataFrame, path: str, checkpoint: str, key: str, record_id: str, seconds: str | None = None):
    """Add the micro-batches of a stream, each once: a batch that is run again after a stop is known by its number."""
    def add(df, number):
        add_crawl(df, path, f"stream-{number}", key, record_id, seconds)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
