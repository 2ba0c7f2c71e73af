import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import corpus, frame, sha
from textlab.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60) | st.text("ab'  \n\r\x1c\x85é中½²_<|endoftext>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_and_text_equal_the_library(text):
    enc = bpe.encoder(PATH)
    want = ids(text)
    assert enc.encode(text) == ",".join(map(str, want))
    assert enc.decode(enc.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)
    assert packing.token_ids(text, PATH).tolist() == want


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000 + "x", "é" * 1500, "abc" * 700, "<|endoftext|>" * 3 + " a<|endoftext|>b", "\n\n \n"])
def test_long_runs_and_added_tokens(text):
    assert bpe.encoder(PATH).encode(text) == ",".join(map(str, ids(text)))
    assert packing.token_ids(text, PATH).tolist() == ids(text)


@pytest.mark.parametrize("gap", [" ", "\t", "\n", " \n\t"])
def test_more_than_a_million_white_space_characters(gap):
    run = gap * (1_100_000 // len(gap))
    body = f"{run}some{run}words<|endoftext|>{run}"
    assert packing.token_ids(body, PATH).tolist() == ids(body)


def test_runs_at_the_border(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 300)
    for body in (" " * 299 + "x", "a" + " " * 300 + "x y", "\n" * 301, "b " * 400):
        assert packing.token_ids(body, PATH).tolist() == ids(body)


def test_packing_of_a_long_run(spark):
    rows = [(1, " " * 1_200_000, *(None,) * 7), (2, "a b", *(None,) * 7)]
    got = packing.pack_documents(frame(spark, rows), PATH).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == len(ids(rows[0][1])) + 1


def test_cuts_are_certain():
    enc = bpe.encoder(PATH)
    piece = "naïveté§ßx".encode()
    parts = enc.cuts(piece)
    assert b"".join(parts) == piece and len(parts) > 1
    for a, b in zip(parts, parts[1:]):
        assert not any(a[-1:] + b[:1] in token for token in enc.id)


def test_cache_generations_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 8)
    enc, rng = bpe.ForcedBPE(PATH), random.Random(1)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    assert enc.encode(text) == ",".join(map(str, ids(text)))


def test_encode_decode_query(spark):
    rows = corpus()
    out = bpe.encode_decode(frame(spark, rows), PATH, with_text=True).collect()
    want = sorted(((r[0], len(ids(r[1])), sha(",".join(map(str, ids(r[1]))).encode()), sha((r[1] or "").encode()), ids(r[1]), r[1] or "") for r in rows), key=str)
    assert sorted(((g.doc_id, g.n_tokens, g.ids_sha256, g.decoded_sha256, g.ids, g.decoded) for g in out), key=str) == want
    assert bpe.encode_decode(frame(spark, rows).limit(0), PATH).count() == 0


@pytest.mark.parametrize("size,tokens", [(2048, packing.TOKENS_PER_TASK), (64, 640)])
def test_packing(spark, size, tokens):
    rows = corpus()
    cut = packing.pieces(frame(spark, rows), PATH, size)
    out = packing.pack(cut, size, open_bins=16, tokens_per_task=tokens).collect()
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append([*ids(r[1]), 0])
    for d, texts in docs.items():
        mine = sorted((g.piece, g.start, g.length, g.ids_crc32) for g in out if g.doc_id == d)
        want = []
        for t in texts:
            first = len(t) % size or min(size, len(t))
            ends = list(range(first, len(t) + 1, size))
            want += [(i, a, b - a, zlib.crc32(np.array(t[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip([0, *ends], ends))]
        assert mine == sorted(want)
    bins = {}
    for g in out:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= size
    total = sum(g.length for g in out)
    assert len(bins) <= 1.1 * total / size + 2
    assert packing.pack(cut.limit(0), size).count() == 0


def test_bounded_best_fit():
    b = packing.BestFit(10, 2, 0)
    assert [b.place(n) for n in (6, 7, 3, 4, 5, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 5)]
    b = packing.BestFit(10, 2, 0)
    assert [b.place(n)[0] for n in (5, 6, 7, 3, 4, 5)] == [0, 1, 2, 3, 1, 0] or b.n_open <= 2
    rng, b = random.Random(3), packing.BestFit(100, 5, 0)
    fill = {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        s, at = b.place(n)
        assert fill.get(s, 0) == at
        fill[s] = at + n
        assert fill[s] <= 100 and b.n_open <= 5 and b.n_open == sum(map(len, b.by_free))
