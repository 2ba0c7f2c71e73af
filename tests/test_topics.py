import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import clustering as CL
from textlab.operators import coherence as H
from textlab.operators import topics as TP


def test_ctfidf_hand(spark):
    df = spark.createDataFrame([("A", ["a", "a", "b"]), ("B", ["b", "c"])], "topic string, toks array<string>")
    got = {(r["topic"], r["word"]): r["weight"] for r in TP.ctfidf(df, "topic", "toks", truncate_mean=False).collect()}
    want = {("A", "a"): 0.540620, ("A", "b"): 0.270310, ("B", "b"): 0.405465, ("B", "c"): 0.626381}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
    trunc = {(r["topic"], r["word"]): r["weight"] for r in TP.ctfidf(df, "topic", "toks").collect()}
    assert trunc[("A", "a")] == pytest.approx(2 / 3 * math.log(2.0))


def brute_windows(docs, width):
    wins = []
    for d in docs:
        if len(d) < width:
            wins.append(set(d))
        else:
            wins.extend(set(d[s:s + width]) for s in range(len(d) - width + 1))
    return wins


def test_window_counts_interval_equals_brute_force(spark):
    rnd = random.Random(3)
    vocab = list("abcdefgh")
    docs = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 25))] for _ in range(30)]
    topics = {0: ["a", "b", "c"], 1: ["d", "e"]}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, toks array<string>")
    pairs, n = H.window_counts(df, "toks", {"m": topics, "one": {0: ["a"]}}, window=5)
    n_windows = n["m"]
    got = {(r["a"], r["b"]): r["co"] for r in pairs.collect()}
    rel = {w for ws in topics.values() for w in ws}
    wins = brute_windows([d for d in docs if rel & set(d)], 5)
    assert n_windows == len(wins)
    need = {(a, b) for ws in topics.values() for a in ws for b in ws if a <= b}
    want = {(a, b): sum(1 for w in wins if a in w and b in w) for a, b in need}
    assert {p: got.get(p, 0) for p in need} == want and set(got) <= need
    assert n["one"] == len(brute_windows([d for d in docs if "a" in d], 5))


def cv_reference(docs, topics, width):
    rel = {w for ws in topics.values() for w in ws}
    wins = brute_windows([d for d in docs if rel & set(d)], width)
    n = len(wins)

    def c(*ws):
        return sum(1 for w in wins if all(x in w for x in ws))

    def npmi(a, b):
        co = c(a, b) / n + 1e-12
        return math.log(co / ((c(a) / n) * (c(b) / n))) / -math.log(co)
    out = {}
    for t, ws in topics.items():
        vw = np.array([sum(npmi(wi, wj) for wi in ws) for wj in ws])
        sims = []
        for wi in ws:
            v = np.array([npmi(wi, wj) for wj in ws])
            sims.append(v @ vw / (np.linalg.norm(v) * np.linalg.norm(vw)))
        out[t] = float(np.mean(sims))
    return out


def test_cv_matches_reference_formula(spark):
    rnd = random.Random(11)
    vocab = list("abcdefghij")
    docs = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 40))] for _ in range(40)]
    topics = {"0": ["a", "b", "c"], "1": ["d", "e", "f"]}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id long, toks array<string>")
    got = {r["topic"]: r["c_v"] for r in H.coherence_cv(df, "id", "toks", topics, window=6).collect()}
    want = cv_reference(docs, topics, 6)
    for t in topics:
        assert got[t] == pytest.approx(want[t], rel=1e-9)


def test_umass_matches_reference_formula(spark):
    docs = [["a", "b"], ["a"], ["b", "c"], ["a", "b", "c"], ["d"]]
    topics = {"0": ["a", "b", "c"]}
    df = spark.createDataFrame([(d,) for d in docs], "toks array<string>")
    got = H.umass(df, "toks", topics).first()["umass"]
    n = len(docs)

    def dcount(*ws):
        return sum(1 for d in docs if all(w in d for w in ws))
    ws = topics["0"]
    vals = [math.log((dcount(ws[i], ws[j]) / n + 1e-12) / (dcount(ws[j]) / n)) for i in range(1, 3) for j in range(i)]
    assert got == pytest.approx(sum(vals) / len(vals))


def test_topic_cosine_matches_numpy(spark):
    rows = [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 0.5), (1, "c", 1.0), (2, "b", 1.0), (2, "c", 1.0)]
    w = spark.createDataFrame(rows, "topic int, word string, weight double")
    got = {(r["topic_a"], r["topic_b"]): r["cosine"] for r in TP.topic_cosine(w, "topic").collect()}
    m = np.array([[1, 2, 0], [0.5, 0, 1], [0, 1, 1]], dtype=float)
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), v in got.items():
        assert v == pytest.approx(m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]))


def test_mds_recovers_distances():
    pts = np.array([[0, 0], [3, 0], [0, 4]], dtype=float)
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    xy = TP.mds_coordinates(d)
    assert np.allclose(np.linalg.norm(xy[:, None] - xy[None], axis=2), d)


def test_assignment_and_probability(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1)],
                                "id int, v array<double>, label int")
    labels, mat = TP.collect_centroids(TP.centroids(emb, "label", "v"), "label")
    out = {r["id"]: r for r in TP.assign_topics(emb, "v", labels, mat).collect()}
    assert out[1]["topic"] == 0 and out[3]["topic"] == 1
    assert all(0.5 <= r["probability"] <= 1.0 for r in out.values())


def test_reduce_topics_gives_n_topics(spark):
    rnd = random.Random(5)
    rows = [(i, i % 6, [rnd.choice("abcdefg") + rnd.choice("xyz") for _ in range(8)]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, topic int, toks array<string>")
    maps = CL.reduce_topics(docs, "topic", "toks", [3, 4])
    for n in (3, 4):
        red = CL.relabel(docs, "topic", maps[n])
        assert red.select("topic").distinct().count() == n and red.count() == 120


def test_merge_path_equals_a_plain_loop():
    """The smallest joins its most similar; similarities average by documents."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        k = 7
        x = rng.random((k, k))
        sim = (x + x.T) / 2
        np.fill_diagonal(sim, 0)
        sizes = {t: int(rng.integers(1, 6)) for t in range(k)}
        groups = {t: [t] for t in range(k)}

        def likeness(a, b):
            w = [(sim[i, j], sizes[i] * sizes[j]) for i in groups[a] for j in groups[b]]
            return sum(s * n for s, n in w) / sum(n for _, n in w)

        want = {}
        while len(groups) > 2:
            if len(groups) <= 5:
                want[len(groups)] = {i: g for g, m in groups.items() for i in m}
            small = min(groups, key=lambda g: (sum(sizes[i] for i in groups[g]), -g))
            into = max((g for g in groups if g != small), key=lambda g: (likeness(small, g), -g))
            groups[into] += groups.pop(small)
        assert CL.merge_path(list(range(k)), sizes, sim, [3, 4, 5]) == {n: want[n] for n in (3, 4, 5)}
    with pytest.raises(ValueError):
        CL.merge_path([0, 1], {0: 1, 1: 1}, np.zeros((2, 2)), [3])


def test_more_than_200_topics(spark):
    rows = [(t, w, 1.0 + t % 3) for t in range(230) for w in (f"w{t}", f"w{(t + 1) % 230}")]
    got = TP.topic_cosine(spark.createDataFrame(rows, "topic int, word string, weight double"), "topic")
    assert got.count() == 230 * 229 // 2 and got.where("cosine > 0").count() == 230


def test_cluster_topics_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)]) for i in range(60)] + [(99, [0.0, 0.0, 0.0]), (98, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["topic"] for r in CL.cluster_topics(df, "v", 3, min_topic_size=5, min_similarity=0.5).collect()}
    assert len(got) == 62 and got[99] == got[98] == -1
    assert len({got[i] for i in range(60)}) == 3 and all(got[i] == got[i % 3] for i in range(60))
    small = CL.cluster_topics(df, "v", 3, min_topic_size=30)
    assert {r["topic"] for r in small.collect()} == {-1}


def test_lda_keeps_every_word(spark):
    from textlab.operators import lda as LD
    rnd = random.Random(2)
    docs = [(i, [rnd.choice("abcdef" if i % 2 else "uvwxyz") for _ in range(20)] + [f"rare{i}"]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>")
    cvm, vec = LD.count_vectors(df, "toks")
    assert len(cvm.vocabulary) == 12 + 60
    model = LD.fit_lda(vec, 2)
    terms = H.collect_topic_words(LD.topic_terms(spark, model, cvm.vocabulary, 6))
    assert sorted("".join(sorted(ws)) for ws in terms.values()) == ["abcdef", "uvwxyz"]
    places = LD.intertopic(spark, model, vec, "toks").collect()
    assert sum(r["prevalence"] for r in places) == pytest.approx(1.0) and places[0]["mean_distance"] > 0.5
    curve = {r["k"]: r for r in LD.lda_sweep(df, "toks", [1, 2], 6).collect()}
    cf = {}
    for _, ws in docs:
        for w in ws:
            cf[w] = cf.get(w, 0) + 1
    n = sum(cf.values())
    assert curve[1]["log_perplexity"] == pytest.approx(-sum(c * math.log((c + 1) / (n + len(cf))) for c in cf.values()) / n)
    assert curve[2]["coherence"] is not None


def test_jensen_shannon():
    p = np.array([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    d = TP.jensen_shannon(p)
    assert d[0, 1] == pytest.approx(math.sqrt(math.log(2))) and np.allclose(np.diag(d), 0) and np.allclose(d, d.T)


def test_topic_info_name(spark):
    docs = spark.createDataFrame([(1, 0, "one"), (2, 0, "two"), (3, 1, "three")], "doc_id long, topic int, text string")
    words = spark.createDataFrame([(0, 1, "x", 0.5), (0, 2, "y", 0.4), (1, 1, "z", 0.9)],
                                  "topic int, rank int, word string, weight double")
    info = {r["Topic"]: r for r in TP.topic_info(docs, "topic", "doc_id", "text", words).collect()}
    assert info[0]["Name"] == "0_x_y" and info[0]["Count"] == 2 and info[0]["Representative_Docs"] == ["one", "two"]


def test_select_best(spark):
    curve = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.4), (4, 0.5), (5, 0.2)], "k int, c double")
    r = {x["k"]: x for x in H.select_best(curve, "k", "c").collect()}
    assert r[2]["is_best"] and not r[4]["is_best"]
    assert [k for k in r if r[k]["is_local_max"]] == [2, 4]


def test_term_relevance(spark):
    w = spark.createDataFrame([(0, "a", 3.0), (0, "b", 1.0), (1, "b", 1.0)], "topic int, word string, weight double")
    cf = spark.createDataFrame([("a", 3), ("b", 7)], "word string, cf long")
    got = {(r["topic"], r["word"]): r["relevance"] for r in TP.term_relevance(w, "topic", cf, 0.6).collect()}
    want = 0.6 * math.log(0.75) + 0.4 * math.log(0.75 / 0.3)
    assert got[(0, "a")] == pytest.approx(want)
    assert got[(1, "b")] == pytest.approx(0.6 * math.log(1.0) + 0.4 * math.log(1.0 / 0.7))


def joined_hash(s):
    h = 0
    for c in s:
        h = (h * TP.HASH_BASE + ord(c)) % TP.HASH_MOD
    return h


@pytest.mark.parametrize("sep,buckets", [(" ", 1024), ("", 4), (" || ", 2)])
def test_hash_of_joined_texts(spark, sep, buckets):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), i * 7 % 101, "".join(rnd.choice("xyzé中 \U0001F600") for _ in range(rnd.randint(0, 30)))) for i in range(101)]
    rows += [("c", 1, None), ("d", 5, "only"), ("e", 1, "L" * 200_000), ("e", 2, "é" * 70_000)]
    df = spark.createDataFrame(rows, "topic string, id long, text string").repartition(4)
    got = {r["topic"]: r for r in TP.concat_stats(df, "topic", "text", "id", sep, buckets).collect()}
    for t in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "") for r in rows if r[0] == t)
        s = sep.join(x for _, x in mine)
        assert (got[t]["n_docs"], got[t]["n_chars"], got[t]["text_hash"]) == (len(mine), len(s), joined_hash(s))


def test_probability_vector(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1)], "id int, v array<double>, label int")
    labels, mat = TP.collect_centroids(TP.centroids(emb, "label", "v"), "label")
    more = emb.select("id", "v").unionByName(spark.createDataFrame([(4, None), (5, [0.0, 0.0])], "id int, v array<double>"))
    for r in TP.assign_topics(more, "v", labels, mat).collect():
        if r["id"] > 3:
            assert r["probabilities"] == [0.0, 0.0] and r["topic"] is None
        else:
            assert sum(r["probabilities"]) == pytest.approx(1.0) and max(r["probabilities"]) == pytest.approx(r["probability"])
            assert int(np.argmax(r["probabilities"])) == r["topic"]


def test_many_models_equal_one_at_a_time(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, [rnd.choice("abcdefgh") for _ in range(9)]) for i in range(40)], "id int, toks array<string>")
    both = df.selectExpr("toks", "id % 2 t2", "id % 5 t5")
    got = {(r["model"], r["topic"], r["word"]): r["weight"] for r in TP.model_ctfidf(TP.model_term_counts(both, {2: "t2", 5: "t5"}, "toks")).collect()}
    for k in (2, 5):
        for r in TP.ctfidf(df.withColumn("t", F.col("id") % k), "t", "toks").collect():
            assert got.pop((k, r["t"], r["word"])) == pytest.approx(r["weight"])
    assert not got
