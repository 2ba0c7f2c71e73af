"""Windows of a text grouped by content-defined anchors: the shared ground of the
two operators that remove repeated substrings.

A window is ``window`` consecutive symbols (words or bytes).  Its anchor is the
``gram``-symbol string in it with the least hash, the leftmost of equals: equal
windows have equal anchors, at the same place.  Consecutive windows with one
anchor occurrence form a segment; every window of a text lies in exactly one
segment, and every ``window``-symbol substring of a segment is one of its
windows.  So a window's other occurrences are all found among the segments with
the same anchor, and nothing else needs to meet.  All segments of an anchor hold
its ``gram`` symbols, which an index therefore takes as one symbol: a window is
then ``window - gram + 1`` symbols long."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import bit_filter, bits_for, cut_lineage, partitions_for, slot_rows, slots_of, with_bit
from textlab.llm.rolling import Windows, mix64, sliding_min

PIECE = 1 << 20
POSITION = np.uint64((1 << 24) - 1)
U = np.uint64


def segments(symbols: np.ndarray, window: int, gram: int):
    """(anchor hash, content hash, start, number of windows, place of the anchor) of every segment."""
    parts = []
    for at in range(0, max(len(symbols) - window + 1, 0), PIECE):
        piece = symbols[at:at + PIECE + window - 1]
        h = Windows(piece)
        starts = np.arange(len(piece) - gram + 1)
        grams = h(starts, starts + gram)
        place = (sliding_min(grams & ~POSITION | starts.astype(U), window - gram + 1) & POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        n = np.diff(np.r_[first, len(place)])
        parts.append((grams[place[first]], h(first, first + n + window - 1), first + at, n, place[first] + at))
    if not parts:
        return np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


class Repeats:
    """Finds the windows of ``docs`` (row_key long, body string) that start more
    than once in the corpus.

    ``symbols`` turns a body into an array of symbols (about ``per_byte`` a byte)
    and ``hashed`` that array into 64-bit hashes; ``index`` is the operator's own engine: it gets the
    distinct segment contents whose anchor has several contents, in shards, and
    returns which of their windows occur in another content.  A content that
    occurs twice itself is repeated whole."""

    def __init__(self, docs: DataFrame, window: int, gram: int, symbols: Callable, hashed: Callable, per_byte: float):
        self.docs, self.window, self.gram = docs, window, gram
        self.sc = docs.sparkSession.sparkContext
        total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        # one anchor in about half the windows that share it
        self.bits = bits_for(total * per_byte * 2 / (window - gram + 2))

        def each(batches):
            for pdf in batches:
                for key, body in zip(pdf["row_key"], pdf["body"]):
                    s = symbols(body)
                    if len(s) >= window:
                        yield key, s, segments(hashed(s), window, gram)

        self.each = each

    def occurrences(self) -> DataFrame:
        """Segments whose anchor occurs twice at least (a few more, by a bitmap of
        fixed size): row_key, start, n, anchor, content."""
        each, bits = self.each, self.bits

        def mark(batches):
            for pdf in batches:
                # mixed once more: anchors are the least of many hashes
                held = [slots_of(mix64(seg[0]), bits) for _, _, seg in each(iter([pdf]))]
                s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
                yield slot_rows(s[np.r_[np.ones(min(2, len(s)), bool), s[2:] != s[:-2]]])  # two of a kind say enough

        bitmap = self.sc.broadcast(bit_filter(self.docs.mapInPandas(mark, "chunk int, low binary"), bits, 2))

        def emit(batches):
            for key, _, (anchor, content, start, n, _) in each(batches):
                ok = with_bit(bitmap.value, slots_of(mix64(anchor), bits))
                if ok.any():
                    start = start[ok]
                    yield np.full(len(start), key), start, n[ok], anchor[ok].view(np.int64), content[ok].view(np.int64)

        cols = ["row_key", "start", "n", "anchor", "content"]
        return cut_lineage(self.docs.mapInPandas(gathered(emit, cols), "row_key long, start int, n int, anchor long, content long"))

    def contents(self, occ: DataFrame) -> DataFrame:
        """Distinct contents of anchors that occur twice at least: anchor, content,
        n, w (occurrences), k (contents of the anchor), least (of their w), row_key
        and start of one."""
        each = cut_lineage(occ.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("w"), F.max("n").alias("n"), F.min("row_key").alias("row_key"),
            F.min_by("start", "row_key").alias("start")))  # fixed-width buffers: hash aggregation
        groups = each.groupBy("anchor").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("k"),
                                            F.min("w").alias("least")).where("all > 1")
        return cut_lineage(each.join(groups.drop("all"), "anchor").select("anchor", "content", "w", "n", "k", "least", "row_key", "start"))

    def texts(self, wanted: DataFrame, n: int) -> DataFrame:
        """The symbols of the wanted contents but for the anchor's: adds ``symbols``
        (binary) and ``at``, the anchor's place among them."""
        each, window, gram, bits = self.each, self.window, self.gram, bits_for(2 * n)

        def place(key, start):
            return mix64(mix64(np.asarray(key, np.int64).view(U)) + np.asarray(start).astype(U))

        def mark(batches):
            for pdf in batches:
                key = pdf["row_key"].to_numpy()
                # a document is looked at if its key is there, a segment if key and start are
                yield slot_rows(slots_of(np.r_[place(key, np.full(len(key), 1 << 40)), place(key, pdf["start"])], bits))

        bitmap = self.sc.broadcast(bit_filter(
            wanted.select("row_key", "start").mapInPandas(mark, "chunk int, low binary"), bits, 1))

        def emit(batches):
            for pdf in batches:
                key = pdf["row_key"].to_numpy()
                pdf = pdf[with_bit(bitmap.value, slots_of(place(key, np.full(len(key), 1 << 40)), bits))]
                for key, s, (_, _, start, n, place_of) in each(iter([pdf])):
                    ok = with_bit(bitmap.value, slots_of(place(np.full(len(start), key), start), bits))
                    if ok.any():
                        start, n, place_of = start[ok], n[ok], place_of[ok]
                        symbols = np.empty(len(start), object)
                        symbols[:] = [s[a:p].tobytes() + s[p + gram:b].tobytes() for a, p, b in
                                      zip(start.tolist(), place_of.tolist(), (start + n + window - 1).tolist())]
                        yield np.full(len(start), key), start, place_of - start, symbols

        found = self.docs.mapInPandas(gathered(emit, ["row_key", "start", "at", "symbols"]),
                                      "row_key long, start int, at int, symbols binary")
        # rows repeated in the corpus have the same key and the same symbols
        return wanted.join(found.dropDuplicates(["row_key", "start"]), ["row_key", "start"])

    def find(self, index: Callable, per_shard: int) -> DataFrame:
        """(row_key, spans): symbol ranges covered by repeated windows, as start << 32 | end, for rows that have any."""
        occ = self.occurrences()
        contents = self.contents(occ)
        # a content that occurs once is repeated where another content has the window
        several = contents.where("k > 1 and least = 1")
        size, n = several.agg(F.sum(F.col("n") + self.window - self.gram), F.count(F.lit(1))).first()
        shards = partitions_for(self.docs.sparkSession, size or 0, per_shard)
        rows = self.texts(several, n).select(
            F.expr(f"pmod(xxhash64(anchor), {shards})").cast("int").alias("shard"),
            "anchor", "content", "w", "n", "at", "symbols")
        blocks = by_blocks(rows, F.col("n") + self.window - self.gram, per_shard)
        found = blocks.mapInPandas(index, "anchor long, content long, lo int, hi int")
        whole = contents.where("w > 1").select("anchor", "content", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
        spans = occ.join(cut_lineage(whole.unionByName(found)), ["anchor", "content"]).select(
            "row_key", (F.shiftleft((F.col("start") + F.col("lo")).cast("long"), 32)
                        + F.col("start") + F.col("hi") + self.window).alias("span"))
        # at most one entry per window of the document
        return cut_lineage(spans.groupBy("row_key").agg(F.collect_set("span").alias("spans")))


def split_off(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` without any span, by a bitmap and so without a shuffle, and the
    others joined with their spans (null for a false positive)."""
    bits = bits_for(spans.count())

    def mark(batches):
        for pdf in batches:
            yield slot_rows(slots_of(mix64(pdf["row_key"].to_numpy().view(U)), bits))

    bitmap = docs.sparkSession.sparkContext.broadcast(
        bit_filter(spans.select("row_key").mapInPandas(mark, "chunk int, low binary"), bits, 1))

    def where(wanted):
        def work(batches):
            for batch in batches:  # Arrow rows pass as they are, whatever their columns
                key = batch.column(batch.schema.get_field_index("row_key")).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(with_bit(bitmap.value, slots_of(mix64(key.view(U)), bits)) == wanted))
        return docs.mapInArrow(work, docs.schema)

    return where(False), where(True).join(spans, "row_key", "left")


def gathered(emit: Callable, cols: list[str], rows: int = 50_000) -> Callable:
    """Joins the small arrays of a generator into frames of about ``rows`` rows."""
    def work(batches):
        held, n = [], 0
        for arrays in emit(batches):
            held.append(arrays)
            n += len(arrays[0])
            if n >= rows:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(cols, zip(*held))})
                held, n = [], 0
        if held:
            yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(cols, zip(*held))})
    return work


def covered(spans, n: int) -> np.ndarray:
    """Mask of n symbols covered by start << 32 | end ranges; none for null."""
    mark = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        v = np.asarray(spans, np.int64)
        np.add.at(mark, v >> 32, 1)
        np.add.at(mark, v & 0xFFFFFFFF, -1)
    return np.cumsum(mark[:-1]) > 0


def by_blocks(rows: DataFrame, length, per_shard: int) -> DataFrame:
    """Contents for the index of their shard's block (kind 0) and, where a shard
    holds more than ``per_shard`` symbols, as queries to its other blocks (kind 1)."""
    sizes = rows.groupBy("shard").agg(F.ceil(F.sum(length) / F.lit(2 * per_shard)).cast("int").alias("blocks"))
    placed = (rows.join(sizes, "shard")
              .withColumn("own", F.expr("pmod(xxhash64(content), blocks)").cast("int")))
    first = placed.withColumn("block", F.col("own")).withColumn("kind", F.lit(0))
    others = (placed.where("blocks > 1 and w = 1")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .where("block <> own").withColumn("kind", F.lit(1)))
    cols = ["shard", "block", "kind", "anchor", "content", "w", "n", "at", "symbols"]
    return (first.select(cols).unionByName(others.select(cols)).repartition("shard", "block")
            .sortWithinPartitions("shard", "block", "kind", "anchor", "content"))


def window_runs(anchor, content, n: np.ndarray, hit: np.ndarray) -> pd.DataFrame:
    """Runs of hit windows of each content; ``hit`` holds the contents' windows on end."""
    start = np.cumsum(n) - n
    edge = np.zeros(len(hit) + 1, bool)
    edge[start], edge[-1] = True, True
    before = np.r_[False, hit[:-1]] if len(hit) else hit
    lo = np.flatnonzero(hit & (~before | edge[:-1]))
    after = np.r_[hit[1:], False] if len(hit) else hit
    hi = np.flatnonzero(hit & (~after | edge[1:]))
    of = np.searchsorted(start, lo, "right") - 1
    return pd.DataFrame({"anchor": anchor[of], "content": content[of], "lo": lo - start[of], "hi": hi - start[of]})
