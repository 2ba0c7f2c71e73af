import random

import corpus_pipeline as P
from tests.llm.fixtures import SCHEMA, corpus, frame, shingle_sets, words

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Classes of rows by all pairs; the least (id, text) stays up to the choice among texts of one id."""
    named = sorted({r[:2] for r in rows if r[0] is not None}, key=str)
    sets, of = shingle_sets(named, 5), list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = of[i], of[j]
                of = [y if o == x else o for o in of]
    groups = {}
    for o, r in zip(of, named):
        groups.setdefault(o, []).append(r)
    return [[r for r in g if r[0] == min(x[0] for x in g)] for g in groups.values()]


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(4)
    rows = corpus()
    a, b = words(rng, 100), words(rng, 100)
    near = [*b[:-1], "other"]
    more = [(300, " ".join(a)), (700, " ".join(a)), (700, " ".join(words(rng, 80))), (700, " ".join(words(rng, 90))),  # a copy beside unique texts
            (800, " ".join(b)), (800, " ".join(near)),                                                               # near copies under one id
            (900, None), (900, ""), (900, "")]
    rows += [(i, t, "xx", "s", None, "q", 1, "z", "k") for i, t in more]
    docs = spark.createDataFrame(rows, SCHEMA).select(P.COLUMNS).repartition(3)
    got = P.near_duplicates(spark, docs, SF).collect()
    kept = sorted(((g.doc_id, g.text) for g in got if g.doc_id is not None), key=str)
    want = brute(rows)
    assert len(kept) == len(want) == len(set(kept))
    for choice in want:
        assert len([k for k in kept if k in choice]) == 1
    assert (700, " ".join(a)) not in kept and (300, " ".join(a)) in kept
    assert len([g for g in got if g.doc_id is None]) == 1
