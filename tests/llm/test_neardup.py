import random

import numpy as np
import pytest

from tests.llm.fixtures import classes, corpus, frame, shingle_sets
from textlab.llm import hnsw, superminhash as S
from textlab.llm.common import components


@pytest.mark.parametrize("k,num,bands,rows_", [(3, 85, 20, 5), (5, 80, 25, 4)])
def test_near_duplicates_equal_all_pairs(spark, k, num, bands, rows_):
    rows = corpus()
    comp, n = classes(rows, k, num, 100)
    got = S.near_duplicates(frame(spark, rows), k, num, 100, bands, rows_).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], c, m, r[0] is not None and r[0] == c) for r, c, m in zip(rows, comp, n)), key=str)
    assert sorted(((g.doc_id, g.component_id, g.n_shingles, g.kept) for g in got), key=str) == want


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, corpus()).limit(0)).count() == 0


def test_group_of_unequal_near_copies_is_resolved_in_blocks(spark, monkeypatch):
    """Many copies that all differ: links that only the rest round finds, over several blocks and salts."""
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "SALT", 3)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(90)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w), *[None] * 7))
    comp, _ = classes(rows, 3, 85, 100)
    assert len(set(comp)) > 1
    got = {g.doc_id: g.component_id for g in S.near_duplicates(frame(spark, rows), 3, 85, 100, 20, 5).collect()}
    assert got == dict(enumerate(comp))


def test_superminhash_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    b = np.r_[a[:480], rng.integers(0, 1 << 63, 120).astype(np.uint64)]
    x, y = S.signature(np.unique(a), 512), S.signature(np.unique(b), 512)
    assert abs((x == y).mean() - 480 / 720) < 0.08
    assert int(x.max() >> np.uint64(32)) < 20       # ranks reached
    few = S.signature(np.unique(a)[:3], 64)         # three shingles fill all slots
    assert int(few.max()) < 64 << 32
    assert len({int(v) >> 32 for v in few}) > 10
    assert (S.signature(np.zeros(0, np.uint64), 8) == np.iinfo(np.uint64).max).all()


def test_whole_number_threshold():
    x, y = np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64)
    assert S.alike(x, y, 85, 100)                   # 17 of 20 exactly
    assert not S.alike(x[:16], y, 85, 100)


def test_shingles_of_words():
    assert len(S.shingles_of("A b\tC\x0bd", 3)) == 2
    assert (S.shingles_of("a B", 3) == S.shingles_of("A\nb", 3)).all()
    assert len(S.shingles_of(" ", 3)) == 1      # not a separator here
    assert len(shingle_sets([(0, "a b c a b c a b c")], 3)[0]) == len(S.shingles_of("a b c a b c a b c", 3)) == 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=16)
    for i in range(300):
        v = rng.normal(size=16)
        if i % 3 == 0:                               # one large group
            v = centre + rng.normal(size=16) * 0.12
        rows.append((i, [float(x) for x in np.float32(v)], 0, 1))
    rows += [(1000, rows[1][1], 0, 1), (1001, [2 * x for x in rows[1][1]], 0, 1), rows[2], (1002, None, 0, 1), (1003, [0.0] * 16, 0, 1),
             (1004, [float("nan")] * 16, 0, 1), (1005, [1.0, None], 0, 1), (1006, [], 0, 1), (1007, [float("inf")] * 16, 0, 1),
             (1008, [1.0, 2.0], 0, 1), (1009, [2.0, 4.0], 0, 1), (None, rows[1][1], 0, 1), (1010, [1e30] * 16, 0, 1), (1011, [1e-30] * 16, 0, 1)]
    return rows


def test_hnsw_links_equal_all_pairs(spark):
    rows = vectors()
    fine = [r for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [hnsw.unit(np.array([r[1]], np.float32))[0] for r in fine]
    links = [[j for j in range(len(fine)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(fine))]
    comp = [r[0] for r in fine]
    for _ in fine:
        comp = [min([comp[i], *[comp[j] for j in links[i]]]) for i in range(len(fine))]
    want = sorted((r[0], len(n), c) for r, n, c in zip(fine, links, comp))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links int").repartition(3)
    got = hnsw.near_duplicates(df, 0.95, block=100).collect()
    assert len(got) == len(rows)
    named = {r[0] for r in fine}
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got if g.vec_id in named) == want
    for g in got:
        assert g.kept == (g.vec_id is not None and g.vec_id == g.component_id)
        if g.vec_id not in named:
            assert (g.n_links, g.component_id) == (0, g.vec_id)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_hnsw_wide_components_are_compared_as_doubles(spark):
    """Tiny and huge doubles are no zero vectors and no infinities, and a cosine just below the
    threshold, which floats would round up to it, is no link."""
    edge = np.arccos(0.95)
    rows = [(1, [1e-50, 0.0]), (2, [3e-50, 1e-52]), (3, [0.0, 1e300]), (4, [1e298, 1e300]), (5, [5e-324, 0.0]), (6, [0.0, 0.0]),
            (10, [-1.0, 0.0]), (11, [-np.cos(edge + 1e-10), -np.sin(edge + 1e-10)]), (12, [-np.cos(edge - 1e-10), np.sin(edge - 1e-10)])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    got = {g.vec_id: (g.n_links, g.component_id) for g in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (0, 6), 10: (1, 10), 11: (0, 11), 12: (1, 10)}
    whole = spark.createDataFrame([(1, [3, 4]), (2, [30, 41]), (3, [-4, 3])], "vec_id long, embedding array<int>")
    assert {g.vec_id: g.component_id for g in hnsw.near_duplicates(whole, 0.95).collect()} == {1: 1, 2: 1, 3: 3}


def test_hnsw_recall_and_audit():
    rng = np.random.default_rng(4)
    v = hnsw.unit(rng.normal(size=(3000, 48)))
    v[:1500:10] = hnsw.unit(v[0] + rng.normal(size=(150, 48)) * 0.01)     # a group larger than the beam
    g = hnsw.HNSW.load(hnsw.HNSW(v, np.arange(3000)).dump())
    assert g.audit(0.95) >= hnsw.RECALL
    r, c = g.linked(v[:400].astype(np.float32), 0.95)
    truth = set(zip(*np.nonzero(v[:400].astype(np.float32) @ g.v.T >= 0.95)))
    assert set(zip(r, c)) <= truth and len(set(zip(r, c))) >= 0.99 * len(truth)
    one = hnsw.HNSW(v[:1], np.arange(1))
    assert one.audit(0.95) == 1.0 and list(one.linked(v[:1].astype(np.float32), 0.95)[1]) == [0]


def test_hnsw_takes_graphs_and_links_in_pieces(spark, monkeypatch):
    """A group of near copies has a link for each pair, which are never held together; graphs move in bounded rows."""
    rng = np.random.default_rng(5)
    v = hnsw.unit(rng.normal(size=(600, 8)))
    v[:300] = hnsw.unit(v[0] + rng.normal(size=(300, 8)) * 0.005)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    plain = sorted(map(tuple, hnsw.near_duplicates(df, 0.95).collect()))
    assert plain[0][1] >= 299
    g = hnsw.HNSW(v, np.arange(600))
    r, c = g.linked(v.astype(np.float32), 0.95)
    for name, value in {"CELLS": 2400, "PIECE": 3000, "VERIFIED": 70}.items():
        monkeypatch.setattr(hnsw, name, value)
    parts = list(g.linked_parts(v.astype(np.float32), 0.95))
    assert max(len(x) for x, _ in parts) <= 2400 < len(r)
    assert sorted(zip(r, c)) == sorted((x, y) for rows, cols in parts for x, y in zip(rows, cols))
    x = spark.createDataFrame([(0, i, row.tolist(), 1) for i, row in enumerate(v)], "shard long, node long, embedding array<float>, w long")
    rows = hnsw.graphs(x, 0.95, 1).collect()
    assert len(rows) > 10 and max(len(row["data"]) for row in rows) <= 3000
    back = hnsw.HNSW.load([row["data"] for row in sorted(rows, key=lambda row: row["piece"])])
    assert np.array_equal(back.v, back.own.astype(np.float32)) and back.more["nodes"].tolist() == list(range(600))
    assert sorted(map(tuple, hnsw.near_duplicates(df, 0.95, block=200).collect())) == plain
