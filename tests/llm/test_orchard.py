import hashlib
import random

import numpy as np
import pytest

from textlab.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, distance int"


def plain(rows, k, rounds, dims, scale=1024):
    """Every distance of every round, in Python integers."""
    kept = [(r[0], [int(np.floor(scale * x)) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in order]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))

    for _ in range(rounds):
        who = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), w in zip(kept, who) if w == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    by = {}
    for _, w, d in got:
        by[w] = by.get(w, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, w, d, by[w], sum(by.values()), sha[w]) for i, w, d in got), key=str)


def rows_of(n, dims, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)], 1, "a", "b", 2) for i in range(n)]
    blank = (1, "a", "b", 2)
    rows += [(n, None, *blank), (n + 1, [], *blank), (n + 2, [float("nan")] * dims, *blank), (n + 3, [None] * dims, *blank),
             (n + 4, [0.5] * (dims + 1), *blank), (n + 5, [float("inf")] + [0.0] * (dims - 1), *blank), (n + 6, [0.0] * dims, *blank),
             (n + 7, [-1e-9] * dims, *blank), rows[3], rows[3], (None, rows[4][1], *blank), (None, rows[5][1], *blank)]
    return rows + [(n + 10 + i, rows[0][1], *blank) for i in range(30)]  # many copies of one vector


@pytest.mark.parametrize("n,dims,k,rounds", [(200, 8, 8, 10), (150, 64, 8, 10), (60, 3, 20, 4), (40, 2, 1, 2)])
def test_rounds_equal_all_distances(spark, n, dims, k, rounds):
    rows = rows_of(n, dims, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = orchard.with_inertia(*orchard.cluster(df, k, rounds, dims))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, rounds, dims)


def test_search_equals_all_distances_with_ties():
    rng = np.random.default_rng(2)
    for dims, k, top in ((1, 12, 4), (2, 30, 6), (16, 200, 1000)):
        c = rng.integers(-top, top + 1, (k, dims))
        c[k // 2] = c[0]  # equal centroids
        v = rng.integers(-top, top + 1, (3000, dims)).astype(np.int64)
        model = orchard.Model(c.tolist())
        who, d, looked = model.nearest(v)
        every = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (who == every.argmin(1)).all() and (d == every.min(1)).all()
    c = np.array([[1000 * i, 0] for i in range(100)])  # far apart: most are never looked at
    assert orchard.Model(c.tolist()).nearest(np.array([[10 * i, 5] for i in range(2000)]))[2] < 2000 * 100 / 2


def test_few_vectors_and_empty_tables(spark):
    blank = (1, "a", "b", 2)
    rows = [(5, [0.25, -0.5], *blank), (6, [0.25, -0.5], *blank), (7, [3.0, 1.0], *blank)]
    got = orchard.with_inertia(*orchard.cluster(spark.createDataFrame(rows, SCHEMA), 8, 3, 2))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 8, 3, 2)
    for none in ([], [(None, [0.25, -0.5], *blank)], [(1, [1.0], *blank)]):
        got = orchard.with_inertia(*orchard.cluster(spark.createDataFrame(none, SCHEMA), 8, 3, 2))
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_huge_components_do_not_overflow(spark):
    blank = (1, "a", "b", 2)
    most = orchard.bound(2)
    rows = [(1, [most / 1024, -most / 1024], *blank), (2, [-most / 1024, most / 1024], *blank), (3, [1e300, 0.0], *blank), (4, [0.0, 0.0], *blank)]
    got = {r.vec_id: r for r in orchard.cluster(spark.createDataFrame(rows, SCHEMA), 1, 0, 2)[0].collect()}
    assert set(got) == {1, 2, 4} and max(r.distance for r in got.values()) >= 2 * most ** 2


def test_model_size_is_checked(monkeypatch):
    monkeypatch.setattr(orchard, "MODEL_BYTES", 100)
    with pytest.raises(ValueError):
        orchard.Model([[i] for i in range(10)])
