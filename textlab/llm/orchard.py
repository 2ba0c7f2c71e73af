"""Centroid clustering of integer vectors with Orchard's search.

Every round assigns all vectors to their nearest centroids and replaces each
centroid by the floor of its vectors' mean.  The search (Orchard 1991): each
centroid has the list of the others, nearest first.  A vector starts at one
centroid and walks along its list; whenever it meets a nearer centroid it jumps to
that one's list and starts there anew, passing over those it has visited.  It stops
when the next centroid of the list lies strictly beyond twice its present distance:
by the triangle inequality neither that one nor any behind it can be nearer or tie.
Of equally near centroids the smaller number wins.

All of it is integer arithmetic, so the result does not depend on the order of the
rows or on how Spark deals them.  A round is one pass over a written table; its
tasks return a count and exact component sums for each centroid, which Spark adds.
Only the model is on the driver: k centroids and their k x k lists.  Its size is
checked against ``MODEL_BYTES``."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage

#: Largest model that is broadcast: centroids, and lists of numbers and squared distances.
MODEL_BYTES = 1 << 28
#: Vectors that one search handles together.
BATCH = 4096


def bound(dims: int) -> int:
    """Largest absolute component with which four times a squared distance fits 63 bits."""
    return int(np.sqrt((1 << 63) / (16 * dims))) // 2


def integers(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors with exactly ``dims`` finite components, each floor(scale * x)."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    whole = F.transform("v", lambda x: F.floor(x * scale))
    most = F.lit(float(bound(dims)))
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) <= most)))
            .select("vec_id", whole.alias("v")))


class Model:
    """Centroids with their lists of neighbours, nearest first (of equally near ones the smaller number)."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        k = len(self.c)
        if k * k * 12 + self.c.nbytes > MODEL_BYTES:
            raise ValueError(f"{k} centroids: their lists exceed {MODEL_BYTES} bytes")
        self.near, self.gap = np.zeros((k, k - 1), np.int32), np.zeros((k, k - 1), np.int64)
        for i in range(k):
            d = ((self.c - self.c[i]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")
            order = order[order != i]
            self.near[i], self.gap[i] = order, d[order]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of every row, and how many distances were computed."""
        n, k = len(v), len(self.c)
        cur, best, at = np.zeros(n, np.int64), ((v - self.c[0]) ** 2).sum(1), np.zeros(n, np.int64)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        looked, live = n, np.arange(n)
        while True:
            live = live[at[live] < k - 1]
            live = live[self.gap[cur[live], at[live]] <= 4 * best[live]]  # strictly beyond twice the distance: done
            if not len(live):
                return cur, best, looked
            to = self.near[cur[live], at[live]]
            at[live] += 1
            new = ~visited[live, to]
            rows, to = live[new], to[new].astype(np.int64)
            visited[rows, to] = True
            looked += len(rows)
            d = ((v[rows] - self.c[to]) ** 2).sum(1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (to < cur[rows]))
            rows, to, d = rows[nearer], to[nearer], d[nearer]
            cur[rows], best[rows], at[rows] = to, d, 0  # jump to its list


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column without nulls, as rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _sums(table: DataFrame, model, k: int) -> list:
    """(centroid, component, sum, count) of the vectors nearest to each centroid; k x dims rows."""
    def work(batches):
        total, n = None, np.zeros(k, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                v = _matrix(b.column(0).slice(s, BATCH))
                who, _, _ = model.value.nearest(v)
                total = np.zeros((k, v.shape[1]), np.int64) if total is None else total
                np.add.at(total, who, v)
                n += np.bincount(who, minlength=k)
        if total is not None:
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(got, pa.int32()), "n": pa.array(n[got]),
                                              "sums": pa.array(list(total[got]), pa.list_(pa.int64()))})

    return (table.select("v").mapInArrow(work, "cluster int, n long, sums array<long>")
            .select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect())


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:",
            vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every vector kept, the final centroids).

    Kept are the vectors with exactly ``dims`` components, none null or not finite; each
    component becomes floor(scale * x), computed in double.  (Vectors with a component beyond
    :func:`bound`, 47 million for 64 components, are not kept: their squared distances would not
    fit a long.)  Centroids 0, 1, ... start as the k vectors whose ``sha256(seed + vec_id)`` is
    smallest, in that order (rows that repeat an id: by components); rows without an id are
    clustered but start none.  Each round assigns every vector to the nearest centroid by squared
    Euclidean distance, of equally near ones the smaller number, and replaces every centroid
    that has vectors by the componentwise floor of their mean; the others stay.  Then vectors
    are assigned once more.  A round that changes no centroid ends the rounds, as the others
    would change none either.  Fewer than k vectors start fewer centroids; a table that keeps
    no vector with an id gives an empty result.  Other columns are not read."""
    spark = vectors.sparkSession
    table = cut_lineage(integers(vectors, dims, scale, vec_id, embedding))
    first = (table.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v")
             .orderBy("h", "v").limit(k).collect())
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], schema), []
    c = [list(r["v"]) for r in first]
    for _ in range(rounds):
        model, new = spark.sparkContext.broadcast(Model(c)), [list(x) for x in c]
        for r in _sums(table, model, len(c)):
            new[r["cluster"]][r["i"]] = int(r["x"]) // int(r["n"])
        if new == c:
            break
        c = new
    model = spark.sparkContext.broadcast(Model(c))

    def work(batches):
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                part = b.slice(s, BATCH)
                who, d, _ = model.value.nearest(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return table.select("vec_id", "v").mapInArrow(work, schema), c


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia and inertia (distance summed over the vector's cluster and over all)
    and centroid_sha256 (of the final centroid's components, joined by commas).  The side that
    is broadcast has one row for each centroid."""
    spark = assigned.sparkSession
    assigned = cut_lineage(assigned)
    own = {r["cluster"]: int(r["x"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    rows = [(i, own[i], sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for i, c in enumerate(centroids) if i in own]
    model = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(model), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
