"""Helpers shared by the operators of this subpackage: tables in the shared
folder, connected components, sorted group streams and bit filters of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["bits_for", "components", "cut_lineage", "ensure_checkpoint_dir", "partitions_for", "read", "runs", "with_bit"]


#: Bits of the largest filter that is broadcast: 2**28 bits are 32 MB.
MOST_BITS = 28
#: Rows of an Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions_for(spark: SparkSession, units: float, per_task: float) -> int:
    """Tasks for ``units`` of work at ``per_task`` each; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(np.ceil(units / per_task)))


def _edge_state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(r)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected link table by alternating
    large-star and small-star steps (Kiveris et al. 2014).

    Returns ``(id, component_id)`` for every id in a link, ``component_id`` the
    smallest id reachable.  Every step joins each edge with the minimum of its
    node, so a node with very many links is an aggregation key with map-side
    combining and a skew-splittable join key, never one collected group.  Each
    round is written to the shared folder; it ends when a round changes nothing."""
    edges = cut_lineage(links.where(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _edge_state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: neighbours above a node move to the node's minimum
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small-star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = cut_lineage(small)
        now = _edge_state(edges)
        if now == state:
            break
        state = now
    stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return stars.unionByName(roots).groupBy("id").agg(F.min("component_id").alias("component_id"))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows sorted by ``keys`` in Arrow batches -> (key, rows) chunks.  A key's
    rows may come in several chunks, so nothing is held beyond a batch."""
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        change[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.append(np.flatnonzero(change), len(pdf))
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[s:e]
            yield tuple(part[k].iloc[0] for k in keys), part


def bit_filter(slots: DataFrame, bits: int, at_least: int, chunk_bits: int = 16) -> np.ndarray:
    """Bitmap of ``2**bits`` slots, set where ``slots`` (chunk int, low binary of
    uint16 slot numbers within the chunk) name a slot at least ``at_least`` times.

    The bitmap's size is fixed by ``bits``, at most MOST_BITS; a fuller bitmap
    only lets more through, what follows is exact."""
    size = 1 << chunk_bits

    def merge(batches):
        held, counts, lows, n = None, None, [], 0

        def fold():
            got = np.bincount(np.frombuffer(b"".join(lows), np.uint16), minlength=size)
            return np.minimum(got if counts is None else counts + got, 2).astype(np.uint8)

        def row():
            return pd.DataFrame({"chunk": [held], "set": [np.packbits(fold() >= at_least).tobytes()]})

        for (c,), part in runs(batches, ["chunk"]):
            if held is not None and c != held:
                yield row()
                counts, lows, n = None, [], 0
            held = c
            lows += [bytes(x) for x in part["low"]]
            n += sum(map(len, part["low"]))
            if n > 1 << 22:  # a chunk's slots are not held beyond this
                counts, lows, n = fold(), [], 0
        if held is not None:
            yield row()

    rows = (slots.repartition("chunk").sortWithinPartitions("chunk")
            .mapInPandas(merge, "chunk int, set binary").collect())  # 2**bits bits at most
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = size // 8
    for r in rows:
        out[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(bytes(r["set"]), np.uint8)
    return out


def bits_for(keys: float) -> int:
    """Bits of a filter for so many keys, eight slots each, within the bound.
    Beyond the bound the filter fills up and lets more through."""
    return int(min(MOST_BITS, max(16, np.ceil(np.log2(8 * max(keys, 1))))))


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def slot_rows(slots: np.ndarray, chunk_bits: int = 16) -> pd.DataFrame:
    """Slots as rows for :func:`bit_filter`, one per chunk."""
    slots = np.sort(slots)
    chunk = slots >> chunk_bits
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(slots) else np.zeros(0, int)
    low = (slots & ((1 << chunk_bits) - 1)).astype(np.uint16)
    return pd.DataFrame({"chunk": chunk[cuts].astype(np.int32),
                         "low": [x.tobytes() for x in np.split(low, cuts[1:])] if len(cuts) else []})


def with_bit(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """True where the bitmap has the slot."""
    return (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
