"""Small corpora with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans int, body string, score string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=3, passage=60):
    """Rows of documents with nulls, empty, short, copied, near-copied and long
    texts, shared passages, a repeated row and columns whose names operators use."""
    rng = random.Random(seed)
    shared = " ".join(words(rng, passage))
    base = words(rng, 120)
    texts = [None, "", " \t\n", "one", "two words", "é ünï çödé", "a" * 500, "ab " * 300, "x" * 200 + "y" + "x" * 200]
    texts += [" ".join(words(rng, rng.randrange(3, 150))) for _ in range(12)]
    texts += [" ".join(words(rng, 30)) + "\n" + shared + " " + " ".join(words(rng, 20)) for _ in range(3)]
    texts += [" ".join(base)] * 3
    for i in range(8):
        near = base[:]
        for _ in range(1 + i):
            near[rng.randrange(len(near))] = f"n{rng.randrange(10 ** 6)}"
        texts.append(" ".join(near))
    texts.append(" ".join(words(rng, 4000, 100_000)))
    rows = [(i, t, "xx", "s", None, "q", 1, "z", "k") for i, t in enumerate(texts)]
    rows.append(rows[15])                      # a repeated row
    rows.append((None, " ".join(base), None, None, None, None, None, None, None))  # no id
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingle_sets(rows, k):
    out = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def classes(rows, k, num, den):
    """component_id of each row by all pairs."""
    sets, root = shingle_sets(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least[find(i)] if r[0] is not None else None for i, r in enumerate(rows)], [len(s) for s in sets]


def covered(seqs, window):
    """Mask of each sequence's symbols covered by windows that occur twice or more."""
    seen = {}
    for s in seqs:
        for i in range(len(s) - window + 1):
            key = tuple(s[i:i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for s in seqs:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i:i + window])] > 1:
                gone[i:i + window] = True
        out.append(gone)
    return out


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
