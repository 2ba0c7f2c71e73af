"""I-Match by plain loops: document frequencies, fingerprints and likeness; a very long text in bounded memory."""

import random
import re
import tracemalloc

import numpy as np

from textlab.llm import imatch

MASK = (1 << 64) - 1


def corpus(rnd, n=150):
    words = [f"{c}{i}" for i in range(400) for c in "ab"] + ["the", "of"] * 40
    docs = [" ".join(rnd.choices(words, k=rnd.randint(0, 40))) for _ in range(n)]
    return docs + ["The, THE; of", None, "", "?!", docs[0], "zz" * 5000]


def by_term(text):
    """A text's terms with their hashes, one word at a time."""
    return {int(imatch.terms(w)[0]) for w in re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))}


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)


def band(docs):
    df = {}
    for d in docs:
        for t in by_term(d):
            df[t] = df.get(t, 0) + 1
    return df, {t for t, k in df.items() if imatch.MIN_DF <= k <= imatch.MAX_SHARE * len(docs)}


def test_frequencies_equal_a_plain_count(spark, monkeypatch):
    docs = corpus(random.Random(8))
    df, want = band(docs)
    assert 0 < len(want) < len(df)
    for held, size in ((1 << 22, 32 << 20), (50, 32 << 20), (50, 500)):
        monkeypatch.setattr(imatch, "HELD", held)
        monkeypatch.setattr(imatch, "RANGE_BYTES", size)
        kept, bits = imatch.band_terms(frame(spark, docs), "text", imatch.MIN_DF, imatch.MAX_SHARE)
        rows = kept.collect()
        got = [int(t) for r in rows for t in imatch.from_planes(r["terms"], np.uint64)]
        assert sorted(got) == sorted(want) and len(rows) <= 1 << bits
        assert all(int(t) >> (64 - bits) == r["range"] for r in rows for t in imatch.from_planes(r["terms"], np.uint64)) or not bits
        lex = imatch.lexicon_of(frame(spark, docs))
        at = (8 * len(lex)).bit_length() - 1
        inside = {t for t in df if lex[t >> (64 - at) >> 3] >> (7 - (t >> (64 - at) & 7)) & 1}
        assert inside == want
    assert imatch.lexicon_of(frame(spark, docs).limit(0)).sum() == 0


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain(text, want):
    import hashlib
    ts = by_term(text)
    kept = ts & want or ts or {int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "little")}
    out = []
    for l in range(imatch.LEVELS):
        for s in range(imatch.SERIES):
            seed = mix((s + 1) * 0x9E3779B97F4A7C15 & MASK) | 1
            members = [v for v in map(mix, kept) if v + mix(v) * seed & MASK <= (1 << 64) // 4 ** (l + 1) - 1]
            out.append(mix(sum(members) & MASK) % 65535 + 1 if members else 0)
    return out


def share(x, y):
    if x == y:
        return 1.0
    levels = [list(zip(x[i:i + imatch.SERIES], y[i:i + imatch.SERIES])) for i in range(0, len(x), imatch.SERIES)]
    full = [i for i, lv in enumerate(levels) if 2 * sum(a > 0 or b > 0 for a, b in lv) >= imatch.SERIES]
    at = full[-1] if full else 0
    pairs = [(a, b) for lv in levels[at:at + 2] for a, b in lv if a or b]
    return sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0


def test_fingerprints_and_likeness_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(imatch, "STEP", 7)
    docs = corpus(random.Random(9), 60)
    _, want = band(docs)
    fps = [plain(d, want) for d in docs]
    hexed = lambda fp: "".join(f"{v:04x}" for v in fp)
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, docs)).collect()}
    for i, d in enumerate(docs):
        nxt = i - 1 if i else len(docs) - 1
        body, after = d or "", docs[nxt] or ""
        half = len(body) // 2
        edited = plain(body[:len(body) - half] + after[:half], want)
        assert got[i]["fingerprint"] == hexed(fps[i]) and got[i]["edited_fingerprint"] == hexed(edited), i
        assert abs(got[i]["near_edited"] - share(fps[i], edited)) < 1e-12
        assert abs(got[i]["near_next"] - share(fps[i], fps[nxt])) < 1e-12


def test_a_very_long_text_in_bounded_memory():
    text = " ".join(f"{i:x}" for i in range(3_000_000))
    lex = np.full(1 << (imatch.TERM_BITS - 3), 255, np.uint8)
    tracemalloc.start()
    fp = imatch.fingerprint(text, lex)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (fp > 0).all() and peak < 300 << 20, peak
