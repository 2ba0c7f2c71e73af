"""Packing of tokenised documents into sequences of fixed length: bounded-space
online best-fit.

Every task packs the pieces dealt to it in one pass.  A fixed number of bins is
open at a time; a bitset keyed by free space finds the bin whose free space is
the smallest that still takes the piece, and when one bin too many is open the
fullest closes.  Bins still open at a task's end are dealt to fewer tasks and
packed again, until one round has one task: what that task holds is bounded by
the open bins of the tasks before it."""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.bpe import PATTERN, encoder
from textlab.llm.common import cut_lineage

SIZE = 2048
END_ID = 0
OPEN_BINS = 4096
TOKENS_PER_TASK = 1 << 23
FAN_IN = 16
SLACK = 16


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The vocabulary in the compiled encoder, ranks being ids."""
    enc = encoder(path)
    added = set(enc.added)
    return tiktoken.Encoding("packing", pat_str=PATTERN, special_tokens={},
                             mergeable_ranks={b: i for b, i in enc.id.items() if b.decode("utf-8", "replace") not in added})


#: Runs of white space from this length on are not given to the compiled encoder: its
#: pattern steps back through them and runs out of stack at about a million.
LONG_RUN = 1 << 16


def _has_long_run(text: str) -> bool:
    return (len(text) >= LONG_RUN and re.search(r"\s{256}", text) is not None
            and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text)))


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers; added tokens in it are themselves.
    A text with a very long run of white space is encoded by op5's encoder."""
    enc, fast = encoder(path), _fast(path)
    if _has_long_run(text):
        return np.array(enc.encode(text).split(","), "<u4")
    parts, at = [], 0
    for m in enc.split.finditer(text) if enc.split else ():
        parts += [array("I", fast.encode_ordinary(text[at:m.start()])), array("I", [enc.added[m.group()]])]
        at = m.end()
    parts.append(array("I", fast.encode_ordinary(text[at:] if at else text)))
    return np.concatenate([np.frombuffer(p, np.uint32) for p in parts]).astype("<u4", copy=False)


def pieces(docs: DataFrame, path: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A document is
    its ids and the end id; null text counts as empty, so every row gives at
    least one piece.  Only documents longer than ``size`` are cut; all pieces
    but the first are full."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def work(batches):
        for pdf in batches:
            rows = []
            # nullable ids stay objects, a float would round them
            for d, body in zip(pdf["doc_id"].astype("Int64").astype(object), pdf["body"]):
                ids = np.append(token_ids(body, path), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % size or min(size, len(ids))
                cuts = [0, *range(first, len(ids) + 1, size)]
                rows += [(None if d is pd.NA else d, i, s, e - s, zlib.crc32(ids[s:e].tobytes()))
                         for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return src.mapInPandas(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins by free space; ``place`` returns (bin, offset)."""

    def __init__(self, size: int, open_bins: int, first: int):
        self.size, self.most = size, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.n_open, self.next = 0, 0, first

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        b = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        return b

    def place(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            b = self._take(free)
            self.n_open -= 1
        else:
            b, free, self.next = self.next, self.size, self.next + 1
        left = free - length
        if left:
            if self.n_open >= self.most:  # the fullest closes first
                least = (self.bits & -self.bits).bit_length() - 1
                if left <= least:
                    return b, self.size - free
                self._take(least)
                self.n_open -= 1
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.n_open += 1
        return b, self.size - free

    def still_open(self, slack: int) -> set[int]:
        """Bins with more than ``slack`` tokens free; the others close."""
        return {b for held in self.by_free[slack + 1:] for b in held}


def pack(rows: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS,
         tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """Give every row (with ``length`` <= size) a ``sequence_id`` and ``offset``.

    Rows are dealt by the hash of all their columns and arrive longest first, so
    with as many open bins as a task fills, online best-fit packs as tightly as
    the offline one; the order is fixed, so a task that is run again packs alike.
    Equal rows are told apart only by their place.  An empty table gives an
    empty result."""
    cols = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    done, level, left = None, 0, rows
    while True:
        last = tasks == 1

        def work(batches, last=last, level=level):
            bins = BestFit(size, open_bins, (level << 56) | (TaskContext.get().partitionId() << 32))
            kept = []
            for pdf in batches:
                place = [bins.place(int(n)) for n in pdf["length"]]
                kept.append(pdf.assign(sequence_id=[p[0] for p in place], offset=[p[1] for p in place]))
            if kept:
                out = pd.concat(kept, ignore_index=True)
                out["open"] = False if last else out["sequence_id"].isin(bins.still_open(SLACK))
                yield out[[*cols, "sequence_id", "offset", "open"]]

        dealt = left.withColumn("_h", F.xxhash64(*cols))
        dealt = dealt.repartition(tasks, "_h") if not last else dealt.coalesce(1)
        packed = cut_lineage(dealt.sortWithinPartitions(F.desc("length"), "_h", *cols).select(*cols)
                             .mapInPandas(work, f"{kinds}, sequence_id long, offset long, open boolean"))
        closed = packed.where("not open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        left = packed.where("open").select(*cols)
        tasks, level = max(1, tasks // FAN_IN), level + 1


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise, cut and pack whole documents: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.  See :func:`pieces` for nulls, empty and
    long texts; repeated rows are packed each."""
    return pack(cut_lineage(pieces(docs, path, size)), size, open_bins)
