import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import corpus, frame, sha
from textlab.llm import linededup

SPACE = b" \t\n\x0b\x0c\r"


def brute(rows, least=10):
    """(n_lines, n_dropped, kept hash) of every row, from all lines of all rows."""
    def key(line):
        return line.strip(SPACE).lower()

    held = {}
    for r in rows:
        for line in (r[1] or "").encode().split(b"\n"):
            if r[0] is not None and len(key(line).decode()) >= least:
                held.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").encode().split(b"\n")
        kept = [x for x in lines if r[0] is None or r[0] == min(held.get(key(x), {r[0]}))]
        out.append((r[0], len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, sha((r.kept or "").encode())) for r in df.collect()), key=str)


def lined(seed=5):
    rng = random.Random(seed)
    common = ["A common licence line", "  a COMMON licence line\t", "É commune mais pas ascii", "é commune mais pas ascii",
              "ten points", "nine poin", "éééééééééé", "ééééééééé", "", " \t ", "\x0b\x0cA common licence line\r"]
    rows = corpus()
    n = len(rows)
    for i in range(60):
        body = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()}" for _ in range(rng.randrange(1, 12))]
        if i % 7 == 0:
            body += [body[0]] * 2  # a line repeated in its own document alone counts once
        rows.append((n + i, "\n".join(body) + "\n" * (i % 3), *rows[0][2:]))
    rows.append((n + 3, "A common licence line\nanother text of the same id", *rows[0][2:]))
    return rows


def test_lines_equal_brute_force(spark):
    rows = lined()
    assert got(linededup.remove_repeated_lines(frame(spark, rows))) == brute(rows)


def test_small_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK_KEYS", 3)
    monkeypatch.setattr(linededup, "SLICE_KEYS", 5)
    rows = lined(8)
    assert got(linededup.remove_repeated_lines(frame(spark, rows))) == brute(rows)


def test_full_filters_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BITS", 1)
    monkeypatch.setattr(linededup, "SLICE_KEYS", 1 << 30)
    rows = lined(9)
    assert got(linededup.remove_repeated_lines(frame(spark, rows))) == brute(rows)


def test_long_text_and_empty_table(spark):
    rng = random.Random(2)
    long = "\n".join(f"line number {rng.randrange(40_000)} of a long text" for _ in range(60_000)) + "\n" + "z" * 3_000_000
    blank = (None,) * 7
    rows = [(1, long, *blank), (2, "\n".join(long.split("\n")[:500]), *blank), (3, "\n" * 50_000, *blank)]
    assert got(linededup.remove_repeated_lines(frame(spark, rows))) == brute(rows)
    assert linededup.remove_repeated_lines(frame(spark, [])).collect() == []


def test_copies_of_one_text_lose_all_but_the_first(spark):
    rows = [(i, "the same two lines\nin every document", *(None,) * 7) for i in range(300)]
    out = got(linededup.remove_repeated_lines(frame(spark, rows)))
    assert sum(r[2] for r in out) == 2 * 299 and (0, 2, 0, sha(b"the same two lines\nin every document")) in out


@pytest.mark.parametrize("keys", [10, 5000])
def test_filters_hold_what_was_added(keys):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, keys, dtype=np.uint64)
    pair = linededup.Pair(keys)
    pair.see(h, np.zeros(keys, bool))
    assert pair.once.holds(h).all() and pair.twice.holds(h).mean() < 0.01
    pair.see(h[:keys // 2], np.zeros(keys // 2, bool))
    assert pair.twice.holds(h[:keys // 2]).all() and pair.twice.holds(h[keys // 2:]).mean() < 0.01
    assert int(h[0]) in pair.once


def test_digests_are_of_the_keys():
    assert linededup.digests(b" Hello World! \nhello world!\nshort", 10) == [hashlib.sha256(b"hello world!").digest()]
