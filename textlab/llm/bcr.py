"""Repeated byte windows by column-wise construction of the Burrows-Wheeler
transform and common prefixes of many strings at once.

Round t puts the t-th symbol from the right of every string of a shard's
collection into the transform: its suffix's place follows from the number of
equal symbols before the place of the string's last suffix, and its common
prefix with the neighbours from the least common prefix since the previous equal
symbol.  The transform, the common prefixes and the suffixes' owners are three
files, read and written from end to end once a round (Bauer, Cox and Rosone 2013;
Cox, Garofalo, Rosone and Sciortino 2016).  In the last files, neighbours whose
common prefix reaches the window length are repeated windows.

The strings are the distinct segment contents of the shard's anchors, the
anchor's bytes being one symbol, so rounds are few and short."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import runs
from textlab.llm.rolling import BYTE
from textlab.llm.segments import Repeats, covered, split_off, window_runs

PER_SHARD = 400_000
END = np.uint16(0xFFFF)
BLOCK = 512
ANCHORS = 60_000  # anchors of one collection: symbols 256 and above, below END


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a:b]) of each range a < b; long ranges through block minima."""
    out = np.empty(len(a), values.dtype)
    first, last = -(-a // BLOCK), b // BLOCK
    long = last > first + 1
    if (~long).any():
        out[~long] = _least(values, a[~long], b[~long])
    if long.any():
        tops = np.minimum.reduceat(values, np.arange(0, len(values), BLOCK))
        a, b, first, last = a[long], b[long], first[long], last[long]
        got = _least(tops, first, last)
        for x, y in ((a, first * BLOCK), (last * BLOCK, b)):
            some = x < y
            got[some] = np.minimum(got[some], _least(values, x[some], y[some]))
        out[long] = got
    return out


def _least(values, a, b):
    if not len(a):
        return np.zeros(0, values.dtype)
    order = np.argsort(-a, kind="stable")  # falling starts: the gaps between ranges cost nothing
    pairs = np.empty(2 * len(a), np.int64)
    pairs[::2], pairs[1::2] = a[order], b[order]
    got = np.empty(len(a), values.dtype)
    got[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), pairs)[::2]
    return got


class Columns:
    """The three files of a collection of D strings after some rounds."""

    NAMES = (("bwt", np.uint16), ("lcp", np.uint16), ("who", np.int32))

    def __init__(self, folder: str, d: int):
        self.folder, self.round, self.d = folder, 0, d
        self._write(np.full(d, END), np.zeros(d, np.uint16), np.full(d, -1, np.int32))

    def _path(self, name):
        return os.path.join(self.folder, f"{name}.{self.round}")

    def read(self):
        return [np.fromfile(self._path(n), t) for n, t in self.NAMES]

    def _write(self, *arrays):
        for (n, _), x in zip(self.NAMES, arrays):
            x.tofile(self._path(n))

    def step(self, pos: np.ndarray, symbol: np.ndarray, suffix: np.ndarray, cap: int) -> np.ndarray:
        """Insert one symbol per string; ``pos`` are the places of the strings'
        last suffixes.  Returns the places of the new ones."""
        bwt, lcp, who = self.read()
        bwt[pos] = symbol
        order = np.argsort(bwt, kind="stable")
        n = len(order) - int(np.count_nonzero(bwt == END))
        order = order[:n]  # equal symbols together, in order of place
        is_new = np.zeros(len(bwt), bool)
        is_new[pos] = True
        new = np.flatnonzero(is_new[order])  # their ranks, by rank ...
        new = new[np.argsort(order[new])][np.argsort(np.argsort(pos))]  # ... and by string
        changed = np.unique(np.concatenate([new, new + 1]))
        changed = changed[changed < n]
        at, before = order[changed], order[np.maximum(changed - 1, 0)]
        same = (changed > 0) & (bwt[at] == bwt[before])
        common = np.zeros(len(changed), np.uint16)
        common[same] = np.minimum(least(lcp, before[same] + 1, at[same] + 1) + 1, cap)
        old = np.ones(self.d + n, bool)
        old[self.d + new] = False
        out = [np.empty(self.d + n, t) for _, t in self.NAMES]
        for x, y in zip(out, (bwt, lcp, who)):
            x[old] = y
        out[0][self.d + new], out[2][self.d + new] = END, suffix
        out[1][self.d + changed] = common
        for name, _ in self.NAMES:
            os.unlink(self._path(name))
        self.round += 1
        self._write(*out)
        return self.d + new


def repeated(strings: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For each string: which of its ``depth``-symbol windows occur twice or more
    in the collection.  Symbols are below 65535, strings at least ``depth`` long."""
    sizes = np.array([len(s) for s in strings])
    base = np.cumsum(sizes) - sizes
    text = np.concatenate(strings)
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        files = Columns(folder, len(strings))
        live = pos = np.arange(len(strings))
        pos = pos.copy()
        for t in range(1, int(sizes.max()) + 1):
            live = live[sizes[live] >= t]  # strings that have ended need no place any more
            start = base[live] + sizes[live] - t
            pos[live] = files.step(pos[live], text[start], start.astype(np.int32), depth)
        _, lcp, who = files.read()
    hit = lcp >= depth
    hit |= np.r_[hit[1:], False]
    found = np.zeros(len(text), bool)
    found[who[hit & (who >= 0)]] = True
    return [found[b:b + n - depth + 1] for b, n in zip(base, sizes)]


def index(window: int, gram: int, per_shard: int = PER_SHARD):
    """The engine for :class:`Repeats`: rows of blocks -> repeated windows."""
    depth = window - gram + 1

    def solve(part: pd.DataFrame):
        part = part.sort_values("anchor", kind="stable", ignore_index=True)
        _, meta = np.unique(part["anchor"].to_numpy(), return_inverse=True)
        cuts = np.searchsorted(meta, np.arange(0, meta[-1] + 1 + ANCHORS, ANCHORS))
        for lo, hi in zip(cuts, cuts[1:]):  # an anchor's contents stay together
            piece = part.iloc[lo:hi]
            strings = []
            for m, at, raw in zip(meta[lo:hi] - meta[lo], piece["at"], piece["symbols"]):
                s = np.frombuffer(raw, np.uint8).astype(np.uint16)
                strings.append(np.concatenate([s[:at], np.array([256 + m], np.uint16), s[at:]]))
            hits = repeated(strings, depth)
            once = (piece["w"] == 1).to_numpy()
            if once.any():
                rows = piece[once]
                yield window_runs(rows["anchor"].to_numpy(), rows["content"].to_numpy(), rows["n"].to_numpy().astype(np.int64),
                                  np.concatenate([h for h, o in zip(hits, once) if o]))

    def work(batches):
        at, held, ran, more, size = None, [], False, [], 0

        def run():
            yield from solve(pd.concat(held + more, ignore_index=True))

        for key, part in runs(batches, ["shard", "block"]):
            if key != at:
                if held and (more or not ran):
                    yield from run()
                at, held, ran, more, size = key, [], False, [], 0
            own = (part["kind"] == 0).to_numpy()
            if own.any():
                held.append(part[own])
            if not own.all():  # queries join the block's collection, a piece at a time
                more.append(part[~own])
                size += int(more[-1]["n"].sum()) + len(more[-1]) * depth
                if size >= per_shard and held:
                    yield from run()
                    ran, more, size = True, [], 0
        if held and (more or not ran):
            yield from run()

    return work


def remove_repeats(docs: DataFrame, window: int = 200, gram: int = 144, text: str = "text", doc_id: str = "doc_id",
                   per_shard: int = PER_SHARD) -> DataFrame:
    """Remove every byte (of the UTF-8 text) covered by a ``window``-byte string
    that also starts anywhere else in the corpus, the same document included.

    Returns every input row and column, and n_bytes, n_removed, n_spans (maximal
    removed runs), spans (start and end of each) and kept (the remaining bytes,
    binary, since a run may end inside a character).  Null texts are empty; texts
    under ``window`` bytes lose nothing; a repeated row is a second occurrence of
    all its windows.  An empty table gives an empty result."""
    body = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.struct(*docs.columns).alias("d"), body.alias("body"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"))
    spans = Repeats(src.select("row_key", "body"), window, gram, lambda b: np.frombuffer(b.encode(), np.uint8),
                    lambda s: BYTE[s], 1.0).find(index(window, gram, per_shard), per_shard)
    new = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]

    @F.pandas_udf("n_bytes long, n_removed long, spans array<long>, kept binary")
    def cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for b, s in zip(bodies, spans):
            raw = np.frombuffer(b.encode(), np.uint8)
            gone = covered(s, len(raw))
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            runs_ = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel()
            out.append((len(raw), int(gone.sum()), runs_, raw[~gone].tobytes() if len(runs_) else raw.tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    none, some = split_off(src, spans)
    none = none.select("d", F.struct(
        F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<long>").alias("spans"), F.col("body").cast("binary").alias("kept")).alias("c"))
    both = none.unionByName(some.select("d", cut("body", "spans").alias("c")))
    return both.select(*[F.col(f"d.{c}") for c in docs.columns if c not in new], "c.n_bytes", "c.n_removed",
                       F.expr("size(c.spans) div 2").cast("long").alias("n_spans"), "c.spans", "c.kept")
