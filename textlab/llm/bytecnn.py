"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over overlapping chunks that cover the
whole document, each filter's largest response over all chunks is kept, and a
logistic layer combines these into one probability.  A byte's symbol also says
whether its word stands at least the third time in a row, which a filter of a few
bytes could not see.

Fitting uses a bounded, documented sample: at most ``TRAIN_ROWS`` labelled rows
(smallest hash of the id first), of each at most ``TRAIN_CHUNKS`` chunks of
``TRAIN_BYTES`` bytes spread evenly over the document.  Scoring reads every byte
of every text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.rolling import word_bounds, word_hashes

TRAIN_ROWS = 4000
TRAIN_TEXTS = 8
TRAIN_CHUNKS = 6
TRAIN_BYTES = 512
STEPS = 900
BATCH = 32
SEED = 7
DIM, WIDTH, FILTERS, STRIDE = 8, 8, 32, 2
CHUNK = 1 << 14
PAD = 256
SYMBOLS = 2 * 257
CUT = 0.3


@dataclass
class ByteCNN:
    embed: np.ndarray   # SYMBOLS x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray     # FILTERS
    out_bias: float

    def responses(self, b: np.ndarray) -> np.ndarray:
        """Filter responses at every STRIDE-th place of a padded byte chunk."""
        flat = self.embed[b].ravel()
        n = (len(b) - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STRIDE * DIM * flat.itemsize, flat.itemsize))
        return view @ self.filters

    def pooled(self, raw: bytes) -> np.ndarray:
        best = None
        for b in chunks(raw):
            top = self.responses(b).max(axis=0)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + self.bias, 0)

    def score(self, raw: bytes) -> float:
        z = float(self.pooled(raw) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def symbols(raw: bytes) -> np.ndarray:
    """Symbols of a text's bytes, padded at both ends: the byte, plus 257 in a
    word that equals the two words before it."""
    buf = np.frombuffer(raw, np.uint8)
    b = np.full(len(raw) + 2 * WIDTH, PAD, np.int16)
    b[WIDTH:-WIDTH] = buf
    words = word_hashes(raw)
    if len(words) > 2:
        again = np.r_[False, False, (words[2:] == words[1:-1]) & (words[1:-1] == words[:-2])]
        if again.any():
            starts, ends = word_bounds(buf)
            mark = np.zeros(len(b) + 1, np.int16)
            mark[starts[again] + WIDTH] += 257
            mark[ends[again] + WIDTH] -= 257
            b += np.cumsum(mark[:-1], dtype=np.int16)
    return b


def chunks(raw: bytes):
    """Overlapping chunks of bytes, padded at the document's ends, that leave no place out."""
    b = symbols(raw)
    for at in range(0, len(b) - WIDTH + 1, CHUNK):
        yield b[at:at + CHUNK + WIDTH - 1]


def fit(bags: list[list[bytes]], y: np.ndarray, seed: int = SEED, steps: int = STEPS) -> ByteCNN:
    """Adam on the logistic loss; the gradient runs through each filter's largest
    response only.  Without both labels: a constant model at the observed rate."""
    rng = np.random.default_rng(seed)
    m = ByteCNN(rng.normal(0, 0.5, (SYMBOLS, DIM)).astype(np.float32),
                rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32),
                np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    m.out_bias = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return m
    m.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
    padded = [np.concatenate([symbols(c) for c in bag]) for bag in bags]
    params = [m.embed, m.filters, m.bias, m.out, np.array([m.out_bias], np.float32)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    order: list[int] = []
    for t in range(1, steps + 1):
        if len(order) < BATCH:
            order += list(rng.permutation(len(y)))
        batch, order = order[:BATCH], order[BATCH:]
        grads = [np.zeros_like(p) for p in params]
        lengths = [len(padded[i]) + len(padded[i]) % STRIDE for i in batch]
        b = np.full(sum(lengths), PAD, np.int16)
        for i, s in zip(batch, np.cumsum([0, *lengths])):
            b[s:s + len(padded[i])] = padded[i]
        r = m.responses(b)  # windows that reach into the next document are cut off below
        for i, s, n in zip(batch, np.cumsum([0, *lengths]), lengths):
            lo, hi = s // STRIDE, (s + n - WIDTH) // STRIDE + 1
            at = r[lo:hi].argmax(axis=0) + lo
            top = r[at, np.arange(FILTERS)] + m.bias
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + params[4][0], -30, 30)))
            d = (p - y[i]) / len(batch)
            grads[3] += d * act
            grads[4] += d
            da = d * m.out * (top > 0)
            grads[2] += da
            places = b[(at * STRIDE)[:, None] + np.arange(WIDTH)]       # FILTERS x WIDTH
            x = m.embed[places].reshape(FILTERS, -1)
            grads[1] += (x * da[:, None]).T
            dx = (m.filters.T * da[:, None]).reshape(FILTERS, WIDTH, DIM)
            np.add.at(grads[0], places, dx)
        grads[1] += 1e-5 * m.filters
        grads[3] += 1e-4 * m.out
        lr = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
        for p, g, (a, v) in zip(params, grads, state):
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            p -= (lr * (a / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        m.out_bias = float(params[4][0])
    return m


def training_chunks(raw: bytes) -> list[bytes]:
    """At most TRAIN_CHUNKS chunks, spread evenly from the first to the last byte."""
    if len(raw) <= TRAIN_CHUNKS * TRAIN_BYTES:
        return [raw]
    at = np.linspace(0, len(raw) - TRAIN_BYTES, TRAIN_CHUNKS).astype(int)
    return [raw[i:i + TRAIN_BYTES] for i in at]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          label: str = "quality", rows: int = TRAIN_ROWS) -> ByteCNN:
    """Fit on at most ``rows`` labels and ``2 * rows`` texts.  Null ids or labels are
    left out, null text counts as empty.  Rows that repeat an id and its text count
    once.  Of an id with several texts at most TRAIN_TEXTS are taken, and a second
    one only where every id has its first."""
    picked = (labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
              .where("id is not null and y is not null").distinct()
              .orderBy(F.xxhash64("id"), "id", "y").limit(rows))

    @F.pandas_udf("array<binary>")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: training_chunks(b.encode()))

    # the sample is broadcast: at most `rows` ids
    got = (docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
           .join(F.broadcast(picked), "id").withColumn("h", F.xxhash64("body")))
    # combined before the shuffle, so a repeated id is no hot key; the ranks are over TRAIN_TEXTS rows an id at most
    got = (got.groupBy("id", "y", F.expr(f"pmod(h, {TRAIN_TEXTS})").alias("part")).agg(F.min(F.struct("h", "body")).alias("t"))
           .withColumn("rank", F.row_number().over(Window.partitionBy("id", "y").orderBy("t.h")))
           .orderBy("rank", F.xxhash64("id"), "id", "y").limit(2 * rows).select("id", "y", cut("t.body").alias("c")))
    got = sorted((r["id"], r["y"], [bytes(x) for x in r["c"]]) for r in got.collect())
    return fit([g[2] for g in got], np.array([g[1] for g in got], np.float32))


def predict(docs: DataFrame, model: ByteCNN, text: str = "text", cut: float = CUT) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 where score >=
    cut).  Null text counts as empty and is scored like it; same-named columns
    of the input are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 30 KB

    @F.pandas_udf("double")
    def score(bodies: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(b.encode() if b is not None else b"") for b in bodies], dtype=float)

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
