"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id into shards whose bounds follow from the
data alone (an exact histogram of payload bytes), each shard is written by one
task as a run of gzip files that roll by compressed size, and every header and
digest is made anew from the payload.  A task writes under temporary names; the
names that successful attempts report are then renamed to their final ones, and
a manifest, itself renamed into place, makes the archive visible.  A task that is
run again writes the same bytes under another temporary name.

Files are written and read through ``pyarrow.fs`` by URI, so the folder can be in
any store that both Spark and pyarrow reach."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage, runs

SHARD_BYTES = 32 << 20
MOST_SHARDS = 20_000
ROLL_BYTES = 16 << 20
DATE = datetime.datetime(2024, 1, 1)
BINS = 64
#: Fixed by the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(kind: str, page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}:{digest}')}>"


def record(page, url, payload: bytes, digest: str, refers, date: datetime.datetime = DATE) -> bytes:
    """One record as its own gzip member.  A revisit holds the HTTP headers only."""
    kind = "response" if refers is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page}"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, page, digest)),
            ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", uri),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Block-Digest", "sha1:" + b32(block)), ("WARC-Payload-Digest", "sha1:" + digest),
            ("Payload-Length", len(payload))]
    if page is not None:
        head.append(("Page-ID", page))
    if refers is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers, digest)), ("Refers-To-Page-ID", refers)]
    head.append(("Content-Length", len(block)))
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # the gzip header has no time, so equal records are equal bytes
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> dict:
    """A record's fields, checked against its digests."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    fine = (lines[0].encode() == VERSION and rest[len(block):] == b"\r\n\r\n"
            and head["WARC-Block-Digest"] == "sha1:" + b32(block)
            and (head["WARC-Type"] == "revisit" or (b32(payload) == digest and len(payload) == int(head["Payload-Length"]))))
    return {"page_id": int(head["Page-ID"]) if "Page-ID" in head else None, "url": head["WARC-Target-URI"],
            "payload_bytes": int(head["Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"],
            "refers_to": int(head["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in head else None,
            "verified": fine, "payload": payload if head["WARC-Type"] == "response" else None}


def records(stream, chunk: int = 1 << 20):
    """Decompressed gzip members of a stream, one at a time."""
    z, parts, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(chunk)
        if not raw:
            return
        parts.append(z.decompress(raw))
        raw = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/|/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, folder: str):
    """(Hadoop file system, path, URI) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, path, fs.makeQualified(path).toString().rstrip("/")


def bounds(rows: DataFrame, key: str, size: str, target: int) -> list[int]:
    """Upper bounds (inclusive) of key ranges of about ``target`` bytes each, from
    exact histograms of at most BINS bins a shard; null keys belong to the first
    range.  Depends on the rows alone."""
    lo, hi, total = rows.agg(F.min(key), F.max(key), F.sum(size)).first()
    if lo is None:
        return []
    shards = max(1, -(-int(total or 0) // max(target, -(-int(total or 0) // MOST_SHARDS), 1)))
    target = -(-int(total or 0) // shards)
    width = max(1, -(-(hi - lo + 1) // (BINS * shards)))
    # bins by their first key; those of more than half a shard are divided again
    at = rows.where(F.col(key).isNotNull()).withColumn("_b", F.floor((F.col(key) - lo) / F.lit(width)) * width + lo)
    steps = []
    while True:
        sums = at.groupBy("_b").agg(F.sum(size)).collect()
        big = [x for x, n in sums if n > target // 2 and width > 1]
        steps += [(x + width - 1, n) for x, n in sums if n <= target // 2 or width == 1]
        if not big:
            break
        width = -(-width // BINS)
        at = at.where(F.col("_b").isin(big)).withColumn("_b", F.floor((F.col(key) - F.col("_b")) / F.lit(width)) * width + F.col("_b"))
    out, held = [], 0
    for end, n in sorted(steps):
        if held and held + n > target:
            out.append(last)
            held = 0
        held, last = held + n, end
    return [*out, hi]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write one record per row to ``folder`` and return its URI.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest page id is a response and the others revisit it; smaller payloads
    are all responses.  Null payloads are empty, null URLs become ``urn:page:``.
    Rows without a page id are responses that nothing refers to.  Repeated rows:
    the first is as above, the others revisit it.  An empty table gives an empty
    manifest."""
    spark = pages.sparkSession
    fs, path, uri = qualified(spark, folder)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    pending, final = jpath(path, "_manifest.pending"), jpath(path, "_manifest")
    if fs.exists(final):
        raise FileExistsError(f"{uri} holds an archive")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    ids = cut_lineage(rows.select("page", "n", "digest"))
    first = cut_lineage(ids.where((F.col("n") >= min_bytes) & F.col("page").isNotNull()).groupBy("digest", "n")
                        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    again = ids.join(first, ["digest", "n"]).where("page is not null").select("page", "digest", "first").distinct()
    # headers count too: a shard of very many empty payloads is no better than a large one
    ends = bounds(ids.withColumn("size", F.col("n") + 512), "page", "size", shard_bytes)
    limits = np.array(ends or [0], np.int64)

    @F.pandas_udf("int")
    def shard(page: pd.Series) -> pd.Series:
        p = page.fillna(limits[0]).astype("int64").to_numpy() if page.isna().any() else page.to_numpy()
        return pd.Series(np.searchsorted(limits, p).astype(np.int32))

    none = F.lit(None)
    both = (rows.select("page", F.lit(1).alias("kind"), "url", "payload", "digest", none.cast("long").alias("first"))
            .unionByName(again.select("page", F.lit(0).alias("kind"), none.cast("string").alias("url"),
                                      none.cast("binary").alias("payload"), "digest", "first")))

    def write(batches):
        out, shard_now, seq, refers, seen, before = None, None, 0, {}, set(), None

        def close():
            out["stream"].close()
            return pd.DataFrame([{k: out[k] for k in ("shard", "seq", "tmp", "records", "bytes")} | {"sha1": out["hash"].hexdigest()}])

        for (s,), part in runs(batches, ["shard"]):
            if s != shard_now:
                if out:
                    yield close()
                out, shard_now, seq, refers, seen, before = None, s, 0, {}, set(), None
            for page, kind, link, payload, hexed, target in zip(part["page"], part["kind"], part["url"], part["payload"], part["digest"], part["first"]):
                page = None if pd.isna(page) else int(page)
                if page != before:
                    before, refers, seen = page, {}, set()
                if kind == 0:
                    refers[hexed] = int(target)
                    continue
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                to = refers.get(hexed)
                if to == page and page is not None and hexed not in seen:
                    to = None
                seen.add(hexed)
                raw = record(page, link, bytes(payload), digest, to)
                if out and out["bytes"] + len(raw) > roll_bytes:
                    yield close()
                    out, seq = None, seq + 1
                if not out:
                    store, base = opened(uri)
                    store.create_dir(f"{base}/_temporary", recursive=True)
                    tmp = f"{base}/_temporary/{s:05d}-{seq:05d}.{uuid.uuid4().hex}"
                    out = {"shard": s, "seq": seq, "tmp": tmp, "records": 0, "bytes": 0, "hash": hashlib.sha1(),
                           "stream": store.open_output_stream(tmp, compression=None)}
                out["stream"].write(raw)
                out["hash"].update(raw)
                out["records"] += 1
                out["bytes"] += len(raw)
        if out:
            yield close()

    dealt = both.withColumn("shard", shard("page")).repartitionById(len(limits), F.col("shard"))
    written = cut_lineage(dealt.sortWithinPartitions("shard", "page", "kind", "digest", "url")
                          .mapInPandas(write, "shard int, seq int, tmp string, records long, bytes long, sha1 string"))

    def commit(batches):
        store, base = opened(uri)
        for pdf in batches:
            names = []
            for s, q, tmp, size in zip(pdf["shard"], pdf["seq"], pdf["tmp"], pdf["bytes"]):
                name = f"{base}/part-{s:05d}-{q:05d}.warc.gz"
                if store.get_file_info(tmp).type == pafs.FileType.File:
                    store.move(tmp, name)
                elif store.get_file_info(name).size != size:  # an earlier attempt has renamed it
                    raise FileNotFoundError(tmp)
                names.append(name.rsplit("/", 1)[1])
            yield pdf.assign(file=names)[["file", "shard", "seq", "records", "bytes", "sha1"]]

    (written.mapInPandas(commit, "file string, shard int, seq int, records long, bytes long, sha1 string")
     .write.mode("overwrite").parquet(pending.toString()))
    if not fs.rename(pending, final):
        raise OSError(f"the manifest could not be put in place: {final.toString()}")
    fs.delete(jpath(path, "_temporary"), True)
    return uri


def read_archives(spark: SparkSession, uri: str, payload: bool = False) -> DataFrame:
    """All records of the files in the manifest, digests verified; one file is
    read as a stream by one task.  With ``payload`` also the payload of responses."""
    cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"] + ["payload"] * payload
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
    manifest = spark.read.parquet(f"{uri}/_manifest")
    files = manifest.count()

    def work(batches):
        for pdf in batches:
            for file, n in zip(pdf["file"], pdf["records"]):
                store, base = opened(uri)
                held, size, got = [], 0, 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for raw in records(stream):
                        held.append(parse(raw))
                        size, got = size + len(raw) * payload + 300, got + 1
                        if size > 8 << 20:
                            yield frame(held)
                            held, size = [], 0
                if got != n:
                    raise ValueError(f"{file}: {got} records, the manifest has {n}")
                if held:
                    yield frame(held)

    def frame(held):
        out = pd.DataFrame(held)[cols]
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = manifest.withColumn("i", F.expr("shard * 31 + seq")).repartition(max(1, files), "i")
    return dealt.select("file", "records").mapInPandas(work, schema + ", payload binary" * payload)
