"""Repeated lines across documents, found by two Bloom filters.

Every task turns its documents into blocks of distinct line digests (the texts
stay where they are).  A block sends the first eight bytes of each of its digests
once, with a flag where several of its documents hold it, to the task of its slice
of the hash space.  That task keeps two Bloom filters: a hash that the *once*
filter already holds, or that comes flagged, goes into the *twice* filter, any other
into *once*.  It then answers every block with those of its hashes that the twice
filter holds.

Only these suspects go on: their digests, with the ids of their documents, are
counted exactly by the whole SHA-256 digest, the smallest document id that holds a
line keeps it, and the others get the digests to drop.  A filter's false positive
costs one row there and changes no result.

Nothing is broadcast and no filter has a size bound: there are as many slices as
``SLICE_KEYS`` needs.  A line that a third of all documents hold is one hash for
each block of up to ``BLOCK_KEYS`` digests, then one row of a map-side combined
minimum; its suspects meet that one row in a join whose large side AQE can split."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage, partitions_for, runs
from textlab.llm.rolling import mix64

U = np.uint64
SPACE = b" \t\n\x0b\x0c\r"
#: Digests of a block, and hashes that a slice's pair of filters is made for (2 x 8 MB).
BLOCK_KEYS = 1 << 18
SLICE_KEYS = 1 << 22
#: Bits of a filter for each hash, in blocks of 512, and bits set for each hash.
BITS, PROBES = 16, 4


class Bloom:
    """A Bloom filter whose hashes set ``PROBES`` bits of one 512-bit block."""

    def __init__(self, keys: int):
        self.blocks = max(1, -(-keys * BITS // 512))
        self.words = np.zeros(self.blocks * 8, U)

    def _bits(self, hashes: np.ndarray):
        a, b = mix64(hashes), mix64(hashes ^ U(0x5BD1E995))
        block = (a >> U(32)) * U(self.blocks) >> U(32)
        for i in range(PROBES):
            bit = b >> U(9 * i) & U(511)
            yield (block * U(8) + (bit >> U(6))).astype(np.int64), U(1) << (bit & U(63))

    def add(self, hashes: np.ndarray) -> None:
        for word, bit in self._bits(hashes):
            np.bitwise_or.at(self.words, word, bit)

    def __contains__(self, item) -> bool:
        return bool(self.holds(np.array([item], U))[0])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for word, bit in self._bits(hashes):
            out &= self.words[word] & bit != 0
        return out


class Pair:
    """The once-seen and the twice-seen filter of a slice."""

    def __init__(self, keys: int):
        self.once, self.twice = Bloom(keys), Bloom(keys)

    def see(self, hashes: np.ndarray, several: np.ndarray) -> None:
        """``several``: the hash was seen more than once already where it comes from."""
        h, first, n = np.unique(hashes, return_index=True, return_counts=True)
        again = (n > 1) | self.once.holds(h)
        again[np.isin(h, hashes[several])] = True
        self.twice.add(h[again])
        self.once.add(h[~again])


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes: A-Z only


def _points(key: bytes) -> int:
    return len(key) - sum(0x80 <= b < 0xC0 for b in key)


def eligible(key: bytes, least: int) -> bool:
    """At least ``least`` code points long."""
    return len(key) >= 4 * least or (len(key) >= least and _points(key) >= least)


def digests(body: bytes, least: int) -> list[bytes]:
    """SHA-256 of the distinct keys that count, of a whole text."""
    keys = {line.strip(SPACE) for line in body.lower().split(b"\n")}
    return [hashlib.sha256(k).digest() for k in keys if eligible(k, least)]


def _blocks(docs: DataFrame, least: int) -> DataFrame:
    """block, docs and hashes (int64 each: id and text hash of a document), owner
    (uint32 per digest: its document), digests (32 bytes each)."""
    def work(batches):
        task, n = TaskContext.get().partitionId() << 32, 0
        ids, texts, owner, held = [], [], [], []

        def row():
            nonlocal n
            out = pd.DataFrame({"block": [task + n], "n": [len(held)], "docs": [np.array(ids, np.int64).tobytes()],
                                "hashes": [np.array(texts, np.int64).tobytes()],
                                "owner": [np.array(owner, np.uint32).tobytes()], "digests": [b"".join(held)]})
            n += 1
            for x in (ids, texts, owner, held):
                x.clear()
            return out

        for pdf in batches:
            for d, h, body in zip(pdf["doc_id"], pdf["text_hash"], pdf["body"]):
                mine = digests(body, least)
                for at in range(0, len(mine), BLOCK_KEYS):  # a text with more lines than a block
                    part = mine[at:at + BLOCK_KEYS]
                    if held and len(held) + len(part) > BLOCK_KEYS:
                        yield row()
                    owner += [len(ids)] * len(part)
                    ids.append(d)
                    texts.append(h)
                    held += part
        if held:
            yield row()

    return docs.mapInPandas(work, "block long, n long, docs binary, hashes binary, owner binary, digests binary")


def _heads(digests: bytes) -> np.ndarray:
    """The first eight bytes of every digest."""
    return np.frombuffer(digests, U)[::4]


def _sent(blocks: DataFrame, slices: int) -> DataFrame:
    """What every block tells every slice: its distinct hashes, those that several of its documents hold first."""
    def work(batches):
        for pdf in batches:
            rows = []
            for block, raw in zip(pdf["block"], pdf["digests"]):
                h, n = np.unique(_heads(raw), return_counts=True)
                to = ((h >> U(32)) * U(slices) >> U(32)).astype(np.int64)  # ascending, as the hashes are
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                for s, e in zip(cuts, [*cuts[1:], len(h)]):
                    order = np.argsort(n[s:e] < 2, kind="stable")
                    rows.append((int(to[s]), block, int((n[s:e] > 1).sum()), h[s:e][order].tobytes()))
            yield pd.DataFrame(rows, columns=["slice", "block", "several", "sent"])

    return blocks.select("block", "digests").mapInPandas(work, "slice int, block long, several int, sent binary")


def _answers(sent: DataFrame, keys: int) -> DataFrame:
    """For every block its hashes that the slice's twice filter holds."""
    def work(batches):
        held: list[tuple] = []
        at, pair = None, None

        def answer():
            rows = []
            for block, sent_ in held:
                h = np.frombuffer(sent_, U)
                got = h[pair.twice.holds(h)]
                if len(got):
                    rows.append((block, got.tobytes()))
            held.clear()
            return pd.DataFrame(rows, columns=["block", "suspects"])

        for (s,), part in runs(batches, ["slice"]):
            if s != at:
                if held:
                    yield answer()
                at, pair = s, Pair(keys)
            several = np.concatenate([np.arange(len(x) // 8) < m for x, m in zip(part["sent"], part["several"])])
            pair.see(np.frombuffer(b"".join(part["sent"]), U), several)
            held += zip(part["block"], part["sent"])
        if held:
            yield answer()

    return sent.mapInPandas(work, "block long, suspects binary")


def _suspects(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The suspected lines: doc_id, text_hash, digest."""
    def work(batches):
        for pdf in batches:
            for docs, hashes, owner, raw, told in zip(*(pdf[c] for c in ("docs", "hashes", "owner", "digests", "told"))):
                got = np.flatnonzero(np.isin(_heads(raw), np.frombuffer(b"".join(told), U)))
                who = np.frombuffer(owner, np.uint32)[got]
                yield pd.DataFrame({"doc_id": np.frombuffer(docs, np.int64)[who], "text_hash": np.frombuffer(hashes, np.int64)[who],
                                    "digest": [raw[32 * i:32 * i + 32] for i in got]})

    told = answers.groupBy("block").agg(F.collect_list("suspects").alias("told"))  # a block's own hashes at most
    return (blocks.join(told, "block").select("docs", "hashes", "owner", "digests", "told")
            .mapInPandas(work, "doc_id long, text_hash long, digest binary"))


def remove_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10) -> DataFrame:
    """Texts without the lines that a document with a smaller id also holds.

    Texts are cut at \\n.  A line's key is the line without white space
    (0x20, 0x09-0x0D) at its ends and with A-Z in lower case.  A key of ``least``
    code points or more that two ids hold loses all its lines except those of the
    smallest id.  Returns doc_id, n_lines, n_dropped and kept (the other lines,
    joined by \\n), one row per row of ``docs``.

    Null text counts as empty, and an empty text is one empty line.  Rows without
    an id count for nothing and keep all their lines.  Rows that repeat an id are
    one document: a line in several of them alone is kept in each.  Very long texts
    fill several blocks.  An empty table gives an empty result; other columns of
    ``docs``, whatever their names, are not read."""
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).withColumn("text_hash", F.xxhash64("body"))
    blocks = cut_lineage(_blocks(src.where("doc_id is not null"), least))
    keys = blocks.agg(F.sum("n")).first()[0] or 0
    slices = partitions_for(spark, keys, SLICE_KEYS)
    sent = _sent(blocks, slices).repartitionById(slices, F.col("slice")).sortWithinPartitions("slice")
    suspects = cut_lineage(_suspects(blocks, _answers(sent, -(-keys // slices) + 64)))

    # written, so that both sides of the join are plain exchanges and AQE may split a line with very many suspects
    repeated = cut_lineage(suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                           .where("first < last").select("digest", "first"))
    drops = (suspects.join(repeated, "digest").where("doc_id > first").groupBy("doc_id", "text_hash")
             .agg(F.collect_set("digest").alias("gone")))  # a text's own lines at most

    def apply(batches):
        for pdf in batches:
            rows = []
            for body, gone in zip(pdf["body"], pdf["gone"]):
                lines = body.split(b"\n")
                kept = lines
                if gone is not None:
                    out = {bytes(g) for g in gone}
                    kept = [x for x in lines if len(x) < least or hashlib.sha256(line_key(x)).digest() not in out]
                rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
            new = pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])
            yield pd.concat([pdf["doc_id"].astype("Int64").reset_index(drop=True), new], axis=1)

    return (src.join(drops, ["doc_id", "text_hash"], "left").select("doc_id", "body", "gone")
            .mapInPandas(apply, "doc_id long, n_lines long, n_dropped long, kept binary")
            .withColumn("kept", F.col("kept").cast("string")))
