"""Logistic regression of many models in the same passes (M5, M6, M7).

Texts become rows of hashed term counts in blocks of at most ``BLOCK`` entries.  Every
model of a cross-validation has its weights side by side with the others': one pass over
the blocks gives the loss and gradient of all of them, each over its own training rows,
summed on the executors in pieces of ``PIECE`` features.  The driver holds models only
(features x classes x models, bounded by ``NUM_FEATURES``) and runs one L-BFGS for each;
a model whose step was too long tries half of it in the next pass, one that has converged
leaves.  The number of jobs is that of the slowest model, whatever their number, and
each model gets the numbers that a fit of its own gets.

The objective is that of ``pyspark.ml`` on hashed TF-IDF with standardisation: mean log
loss plus ``reg / 2`` times the squared weights of the features divided by their standard
deviation in the training rows (in which the idf cancels), the intercepts free.  A feature
that is in every training row, or in none, has no weight."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.metrics import classification_metrics, stratified_folds
from textlab.operators.phrases import bag_of_words
from textlab.operators.stats import drop_null_labels
from textlab.session import cut_lineage

NUM_FEATURES = 1 << 16
#: Entries of a block (a longer text is a block of its own) and features of a piece.
BLOCK, PIECE = 1 << 16, 1 << 12
#: Steps at most (as :func:`textlab.operators.classify.text_pipeline`), passes, pairs that L-BFGS remembers, and the
#: relative change of the loss that ends a fit before.
STEPS, PASSES, MEMORY, TOLERANCE = 30, 400, 10, 1e-6


def _blocks(df: DataFrame, id_col: str, tokens: str, label: str, part: str, classes: list, features: int) -> DataFrame:
    """ids (array), label and part (int32 per row), row, feature (int32) and n (float64) per entry, the features of a row distinct."""
    kind = df.schema[id_col].dataType.simpleString()
    toks = F.array_compact(F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    src = df.select(F.col(id_col).alias("id"), (F.array_position(F.lit(classes), F.col(label)) - 1).cast("int").alias("y"),
                    F.col(part).cast("int").alias("part"), bag_of_words(toks).alias("b"))
    src = src.select("id", "y", "part", F.transform("b", lambda x: F.pmod(F.hash(x["token"]), F.lit(features))).alias("j"), F.col("b.n").alias("n"))

    def work(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        rows, size = [], 0

        def block():
            nonlocal rows, size, made
            each = np.array([len(r[3]) for r in rows])
            if each.sum():
                key = np.repeat(np.arange(len(rows)), each) * features + np.concatenate([np.asarray(r[3], np.int64) for r in rows])
                key, place = np.unique(key, return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([np.asarray(r[4], float) for r in rows]))
            else:
                key, n = np.zeros(0, np.int64), np.zeros(0)
            out = pd.DataFrame({"block": [task + made], "ids": [[r[0] for r in rows]],
                                "y": [np.array([r[1] for r in rows], np.int32).tobytes()], "part": [np.array([r[2] for r in rows], np.int32).tobytes()],
                                "row": [(key // features).astype(np.int32).tobytes()], "feature": [(key % features).astype(np.int32).tobytes()],
                                "n": [n.tobytes()]})
            rows, size, made = [], 0, made + 1
            return out

        for pdf in batches:
            for r in zip(pdf["id"], pdf["y"], pdf["part"], pdf["j"], pdf["n"]):
                if rows and (size + len(r[3]) > BLOCK or len(rows) >= BLOCK):
                    yield block()
                rows.append((None if pd.isna(r[0]) else r[0], *r[1:]))
                size += len(r[3])
        if rows:
            yield block()

    return src.mapInPandas(work, f"block long, ids array<{kind}>, y binary, part binary, row binary, feature binary, n binary")


def _tasks(spark) -> int:
    """Tasks of a pass: one for each core.  Every task writes a gradient as large as the live models
    in every pass, so that more tasks than run at once only cost disk."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _arrays(r):
    """y, part, row, feature, n of a block."""
    return (*(np.frombuffer(r[c], np.int32) for c in ("y", "part", "row", "feature")), np.frombuffer(r["n"], np.float64))


def _rows_times(row, feature, n, many: int, weights: np.ndarray) -> np.ndarray:
    """X W of a block: one row per text, zeros for a text without words."""
    out = np.zeros((many, weights.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[starts]] = np.add.reduceat(weights[feature] * n[:, None], starts, axis=0)
    return out


def _summed(parts: DataFrame, pieces: int) -> dict[int, np.ndarray]:
    """The sum of the ``values`` of each ``piece``, added up on the executors."""
    def add(batches):
        held = {}
        for pdf in batches:
            for p, v in zip(pdf["piece"], pdf["values"]):
                v = np.frombuffer(v, np.float64)
                held[p] = held[p] + v if p in held else v
        if held:
            yield pd.DataFrame({"piece": list(held), "values": [v.tobytes() for v in held.values()]})

    rows = parts.repartition(max(1, min(pieces, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "piece").mapInPandas(add, parts.schema)
    return {r["piece"]: np.frombuffer(bytes(r["values"]), np.float64) for r in rows.collect()}  # as large as the models


def _in_pieces(table: np.ndarray):
    """A features x anything table as rows of (piece, bytes), without pieces of zeros."""
    for p in range(-(-len(table) // PIECE)):
        part = table[p * PIECE:(p + 1) * PIECE]
        if part.any():
            yield p, np.ascontiguousarray(part).tobytes()


def _whole(got: dict, features: int, width: int) -> np.ndarray:
    out = np.zeros((features, width))
    for p, v in got.items():
        if p >= 0:
            out[p * PIECE:(p + 1) * PIECE] = v.reshape(-1, width)
    return out


@dataclass
class Models:
    """``weights[feature, model, margin]`` for term counts, ``intercepts[model, margin]`` and the passes it took.
    With ``binary`` there is one margin, of the second class."""
    classes: list
    held_out: list
    binary: bool
    weights: np.ndarray
    intercepts: np.ndarray
    loss: list = field(default_factory=list)
    passes: int = 0


class _Fit:
    """L-BFGS of one model: :meth:`next` is the point to try, :meth:`tell` takes its value and gradient."""

    def __init__(self, x: np.ndarray, steps: int, tolerance: float):
        self.x, self.f, self.g, self.d, self.t, self.pairs = x, None, None, None, 1.0, []
        self.left, self.tolerance, self.done = steps, tolerance, False

    def next(self) -> np.ndarray:
        return self.x if self.f is None else self.x + self.t * self.d

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.f is not None:
            if not f <= self.f + 1e-4 * self.t * (self.g @ self.d):  # also where f is no number
                self.t /= 2
                self.done = self.t < 1e-10
                return
            new, small = self.next(), self.f - f <= self.tolerance * max(abs(f), abs(self.f), 1e-12)
            s, y = new - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
            self.x, self.left = new, self.left - 1
            self.done = small or self.left <= 0
        self.f, self.g = f, g
        norm = np.sqrt(g @ g)
        self.done = self.done or norm < 1e-10
        q, first = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            first.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(first)):
            q += (a - (y @ q) / (s @ y)) * s
        self.d, self.t = -q, 1.0 if self.pairs else min(1.0, 1.0 / max(norm, 1e-12))


def _loss(margins: np.ndarray, y: np.ndarray, use: np.ndarray, binary: bool):
    """(losses, residuals) of rows x models x margins; rows a model does not use count nothing."""
    if binary:
        m, t = margins[:, :, 0], (y == 1).astype(float)[:, None]
        loss = np.logaddexp(0.0, m) - t * m
        return (loss * use).sum(0), ((np.exp(-np.logaddexp(0.0, -m)) - t) * use)[:, :, None]
    top = margins.max(axis=2, keepdims=True)
    e = np.exp(margins - top)
    total = e.sum(2, keepdims=True)
    own = np.take_along_axis(margins, y[:, None, None].astype(int).repeat(margins.shape[1], 1), 2)[:, :, 0]
    loss = np.log(total[:, :, 0]) + top[:, :, 0] - own
    p = e / total
    p[np.arange(len(y)), :, y] -= 1
    return (loss * use).sum(0), p * use[:, :, None]


def fit_models(blocks: DataFrame, classes: list, held_out: list, binary: bool, features: int, reg: float,
               steps: int = STEPS, tolerance: float = TOLERANCE) -> Models:
    """One model for each entry of ``held_out``: fitted on the rows of all parts but that one (None: on all rows)."""
    many, c = len(held_out), len(classes)
    margins = 1 if binary else c
    spark, pieces = blocks.sparkSession, -(-features // PIECE) + 1
    held = np.array([-1 if h is None else h for h in held_out])

    def statistics(batches):
        sums, counts = np.zeros((features, 3 * many)), np.zeros((many, c))
        for pdf in batches:
            for r in pdf.to_dict("records"):
                y, part, row, feature, n = _arrays(r)
                for m, h in enumerate(held):
                    use = part != h
                    counts[m] += np.bincount(y[use], minlength=c)
                    mine = use[row]
                    for i, v in enumerate((np.ones_like(n), n, n * n)):
                        sums[:, 3 * m + i] += np.bincount(feature[mine], weights=v[mine], minlength=features)
        rows = [*_in_pieces(sums), (-1, counts.tobytes())]
        yield pd.DataFrame(rows, columns=["piece", "values"])

    schema = "piece int, values binary"
    got = _summed(blocks.mapInPandas(statistics, schema), pieces)
    counts = got.get(-1, np.zeros(many * c)).reshape(many, c)
    n = counts.sum(1)
    s = _whole(got, features, 3 * many).reshape(features, many, 3)
    variance = np.maximum(s[:, :, 2] - s[:, :, 1] ** 2 / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
    keep = (s[:, :, 0] > 0) & (s[:, :, 0] < n) & (variance > 1e-14)
    scale = np.where(keep, 1.0 / np.sqrt(np.where(keep, variance, 1.0)), 0.0)
    used = np.flatnonzero(keep.any(axis=1))  # passes handle the features that some model weighs
    size, pieces = len(used), -(-len(used) // PIECE) + 1
    lookup = np.full(features, -1, np.int32)
    lookup[used] = np.arange(size)
    places = spark.sparkContext.broadcast(lookup)
    s, keep, scale = s[used], keep[used], scale[used]
    centre = s[:, :, 1] / np.maximum(n, 1) * scale  # features are centred in the search, which shifts the intercepts only

    share = np.maximum(counts, 0.5) / np.maximum(n, 1)[:, None]
    start = (np.log(share[:, 1:] / share[:, :1]) if binary and c > 1 else np.zeros((many, margins)) if binary
             else np.log(share) - np.log(share).mean(1, keepdims=True))
    place = [np.flatnonzero(keep[:, m]) for m in range(many)]  # a model's own features
    fits = [_Fit(np.concatenate([np.zeros(len(place[m]) * margins), start[m]]), steps, tolerance) for m in range(many)]

    def unpack(m, x):
        w = np.zeros((size, margins))
        w[place[m]] = x[:-margins].reshape(-1, margins)
        return w, x[-margins:] - centre[:, m] @ w

    passes = 0
    while passes < PASSES and n.min(initial=1) > 0 and c > 1:
        live = [m for m in range(many) if not fits[m].done]
        if not live:
            break
        points = [unpack(m, fits[m].next()) for m in live]
        shared = spark.sparkContext.broadcast((np.concatenate([w * scale[:, [m]] for m, (w, _) in zip(live, points)], axis=1),
                                               np.stack([b for _, b in points]), held[live]))

        def gradient(batches):
            weights, intercepts, out = shared.value
            grad, end = np.zeros(weights.shape), np.zeros((len(out), margins + 1))
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    y, part, row, feature, x = _arrays(r)
                    feature = places.value[feature]
                    known = feature >= 0
                    row, feature, x = row[known], feature[known], x[known]
                    at = _rows_times(row, feature, x, len(y), weights).reshape(len(y), len(out), margins) + intercepts
                    loss, rest = _loss(at, y, part[:, None] != out, binary)
                    end[:, 0] += loss
                    end[:, 1:] += rest.sum(0)
                    rest = rest.reshape(len(y), -1)
                    for j in range(rest.shape[1]):
                        grad[:, j] += np.bincount(feature, weights=x * rest[row, j], minlength=len(grad))
            yield pd.DataFrame([*_in_pieces(grad), (-1, end.tobytes())], columns=["piece", "values"])

        got = _summed(blocks.mapInPandas(gradient, schema), pieces)
        shared.unpersist()
        passes += 1
        grad, end = _whole(got, size, len(live) * margins), got[-1].reshape(len(live), margins + 1)
        for i, m in enumerate(live):
            x = fits[m].next()
            w = x[:-margins]
            g = grad[:, i * margins:(i + 1) * margins] * scale[:, [m]] - centre[:, [m]] * end[i, 1:]
            g = (g / n[m])[place[m]].ravel()
            fits[m].tell(end[i, 0] / n[m] + reg / 2 * (w @ w), np.concatenate([g + reg * w, end[i, 1:] / n[m]]))
    both = [unpack(m, fits[m].x) for m in range(many)]
    weights = np.zeros((features, many, margins))
    weights[used] = np.stack([w * scale[:, [m]] for m, (w, _) in enumerate(both)], axis=1)
    return Models(classes, held_out, binary, weights, np.stack([b for _, b in both]),
                  [f.f for f in fits], passes)


def predict(blocks: DataFrame, models: Models, kind: str) -> DataFrame:
    """(fold, id, label, prediction, probability) for every row, by the model that held its part out;
    probability holds that of each class."""
    shared = blocks.sparkSession.sparkContext.broadcast(models)  # as large as the models

    def work(batches):
        m = shared.value
        width = m.intercepts.shape[1]
        of = {h: i for i, h in enumerate(m.held_out)}
        for pdf in batches:
            for r in pdf.to_dict("records"):
                y, part, row, feature, n = _arrays(r)
                at = _rows_times(row, feature, n, len(y), m.weights.reshape(len(m.weights), -1)).reshape(len(y), -1, width) + m.intercepts
                at = at[np.arange(len(y)), [of[p] for p in part]]
                at = np.concatenate([np.zeros_like(at), at], axis=1) if m.binary else at
                e = np.exp(at - at.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                yield pd.DataFrame({"fold": part, "id": list(r["ids"]), "y": y, "p": p.argmax(1), "probability": list(p)})

    classes = F.lit(models.classes)
    rows = blocks.mapInPandas(work, f"fold int, id {kind}, y int, p int, probability array<double>")
    return rows.select("fold", "id", F.get(classes, F.col("y")).alias("label"), F.get(classes, F.col("p")).alias("prediction"), "probability")


def cross_validate(df: DataFrame, id_col: str, label: str, k: int, tokens: str = "toks", binary: bool = False, seed: int = 42,
                   features: int = NUM_FEATURES, reg: float = 0.01, steps: int = STEPS, tolerance: float = TOLERANCE):
    """M7 with all folds in the same passes: ``(predictions, per_fold, models)``.

    Predictions are (fold, id, label, prediction, probability) for every row with a label, each
    by the model that did not see its fold; per_fold has n, accuracy and weighted F1.  ``binary``
    asks for two classes.  Null and empty token arrays are rows without words; no labelled rows
    give empty tables.  Where all labels are equal every prediction is that label."""
    folded = cut_lineage(stratified_folds(drop_null_labels(df, label), label, id_col, k, seed))
    classes = sorted(r[0] for r in folded.select(label).distinct().collect())  # as many as a model has classes
    if binary and len(classes) > 2:
        raise ValueError(f"two classes wanted, {len(classes)} found")
    if not classes:
        empty = folded.select("fold", F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(label).alias("prediction"),
                              F.lit(None).cast("array<double>").alias("probability"))
        return empty, classification_metrics(empty, "label", "prediction", by=["fold"]), None
    binary = binary and len(classes) == 2
    made = cut_lineage(_blocks(folded, id_col, tokens, label, "fold", classes, features))
    blocks = made.repartition(_tasks(df.sparkSession), "block").persist()
    models = fit_models(blocks, classes, list(range(k)), binary, features, reg, steps, tolerance)
    preds = cut_lineage(predict(blocks, models, made.schema["ids"].dataType.elementType.simpleString()))
    blocks.unpersist()
    return preds, classification_metrics(preds, "label", "prediction", by=["fold"]), models
