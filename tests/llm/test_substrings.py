import random

import numpy as np
import pytest

from tests.llm.fixtures import corpus, covered, frame
from textlab.llm import bcr, fmindex
from textlab.llm.segments import segments, window_runs
from textlab.llm.rolling import PIECE, SPACE, Windows, sliding_min, word_hashes


def rows_with_variants():
    """The awkward rows, and passages whose repeats begin and end at different places."""
    rng, rows = random.Random(9), corpus()
    line = [f"p{i}" for i in range(200)]
    for i in range(25):
        a = rng.randrange(0, 120)
        mid = line[a:a + rng.randrange(30, 80)]
        if i % 4 == 0:
            mid[len(mid) // 2] = f"changed{i}"
        rows.append((500 + i, " ".join([f"u{i}x{j}" for j in range(10)] + mid + [f"v{i}x{j}" for j in range(10)]), *[None] * 7))
    return rows


@pytest.mark.parametrize("per_shard", [fmindex.PER_SHARD, 150])
def test_words_equal_brute_force(spark, per_shard):
    rows = rows_with_variants()
    seqs = [(r[1] or "").encode().split() for r in rows]
    masks = covered(seqs, 35)
    want = sorted(((r[0], r[1] if r[1] is None or not m.any() else b" ".join(w for w, g in zip(s, m) if not g).decode(),
                    len(s), int(m.sum())) for r, s, m in zip(rows, seqs, masks)), key=str)
    got = fmindex.remove_repeats(frame(spark, rows), per_shard=per_shard)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "body", "score", "n_words", "n_removed"]
    assert sorted(((g.doc_id, g.text, g.n_words, g.n_removed) for g in got.collect()), key=str) == want
    assert sum(w[3] for w in want) > 500


@pytest.mark.parametrize("per_shard", [bcr.PER_SHARD, 700])
def test_bytes_equal_brute_force(spark, per_shard):
    rows = rows_with_variants()
    seqs = [(r[1] or "").encode() for r in rows]
    want = []
    for r, s, m in zip(rows, seqs, covered(seqs, 200)):
        edge = np.flatnonzero(np.diff(np.r_[0, m.astype(int), 0]))
        want.append((r[0], len(s), int(m.sum()), len(edge) // 2, edge.tolist(), np.frombuffer(s, np.uint8)[~m].tobytes()))
    got = bcr.remove_repeats(frame(spark, rows), per_shard=per_shard).collect()
    assert sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.spans, bytes(g.kept)) for g in got), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = frame(spark, corpus()).limit(0)
    assert fmindex.remove_repeats(none).count() == 0
    assert bcr.remove_repeats(none).count() == 0


def test_every_window_lies_in_one_segment():
    rng = np.random.default_rng(3)
    s = np.r_[rng.integers(0, 3, 700), np.zeros(300, int), rng.integers(0, 1 << 60, 500)].astype(np.uint64)
    anchor, content, start, n, place = segments(s, 35, 12)
    assert (np.repeat(start, n) + np.concatenate([np.arange(k) for k in n]) == np.arange(len(s) - 34)).all()
    assert ((place >= start + n - 1) & (place + 12 <= start + 35)).all()    # the anchor lies in each of its windows
    assert len(segments(s[:34], 35, 12)[0]) == 0


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(5)
    strings = [rng.integers(0, 4, 40).astype(np.uint64) for _ in range(20)]
    fm, query = fmindex.FMIndex(strings, 8), np.concatenate([rng.integers(0, 5, 60), strings[3][:20]]).astype(np.uint64)
    ends = np.arange(8, len(query))
    got = fm.matching(fm.codes(query), ends, 8, 1)
    for e, m in zip(ends, got):
        best = max((k for k in range(9) if k == 0 or any((s[i:i + k] == query[e - k + 1:e + 1]).all()
                                                          for s in strings for i in range(len(s) - k + 1))))
        assert m == best


def test_column_wise_transform_is_the_suffix_order(tmp_path):
    rng = np.random.default_rng(6)
    strings = [rng.integers(0, 3, n).astype(np.uint16) for n in (5, 12, 9, 12, 1)]
    sizes = np.array([len(s) for s in strings])
    base = np.cumsum(sizes) - sizes
    files, pos = bcr.Columns(str(tmp_path), len(strings)), np.arange(len(strings))
    for t in range(1, 13):
        live = np.flatnonzero(sizes >= t)
        start = base[live] + sizes[live] - t
        pos[live] = files.step(pos[live], np.concatenate(strings)[start], start.astype(np.int32), 99)
    _, lcp, who = files.read()
    suffixes = {int(b + i): tuple(s[i:].tolist()) for b, s in zip(base, strings) for i in range(len(s))}
    order = [suffixes[w] for w in who[len(strings):].tolist()]
    assert order == sorted(suffixes.values())
    for x, y, n in zip(order, order[1:], lcp[len(strings) + 1:].tolist()):
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        assert k == n


def test_least_of_ranges():
    rng = np.random.default_rng(8)
    v = rng.integers(0, 1000, 5000).astype(np.uint16)
    a = rng.integers(0, 4999, 300)
    b = np.array([rng.integers(x + 1, 5001) for x in a])
    assert (bcr.least(v, a, b) == [v[x:y].min() for x, y in zip(a, b)]).all()


def test_hashes_of_words_and_windows():
    raw = " a bb\tccc\x0bé\n a".encode()
    h = word_hashes(raw)
    assert len(h) == 5 and h[0] == h[4] and len(set(h.tolist())) == 4
    long = b"word " * (PIECE // 5) + b"x" * 50 + b" end"
    assert len(word_hashes(long)) == PIECE // 5 + 2 and len(np.unique(word_hashes(long))) == 3
    assert len(word_hashes(b"y" * (PIECE + 5))) == 1
    w = Windows(h)
    assert w(np.array([0]), np.array([1]))[0] == w(np.array([4]), np.array([5]))[0]
    x = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    assert (sliding_min(x, 9) == [x[i:i + 9].min() for i in range(49)]).all() and SPACE.sum() == 6


def test_window_runs():
    n = np.array([3, 2, 4])
    hit = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], bool)
    out = window_runs(np.array([7, 8, 9]), np.array([1, 2, 3]), n, hit)
    assert out.values.tolist() == [[7, 1, 0, 1], [8, 2, 0, 1], [9, 3, 0, 0], [9, 3, 3, 3]]
