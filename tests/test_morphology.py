"""Word forms against the rules by hand and against a plain loop over random words."""

import random
import re

from textlab.functions.wordlists import LEMMAS
from textlab.operators import morphology as M


def forms(spark, words, lemmas=()):
    d = spark.createDataFrame([(list(words),), (None,), ([None],), ([],)], "t array<string>")
    fixed = lemmas or [("zzz", "zzz", "X")]
    return {r["word"]: (r["lemma"], r["pos"], r["known_by"]) for r in M.word_forms(d, "t", fixed).collect()}


def test_by_hand(spark):
    words = ("walk walks walked walking run running runs city cities big bigger biggest teach teacher make making baked "
             "bake quickly quick happiness nation famous sing bus thing wolves stopped stop try tried tries trying larger largest large").split()
    got = forms(spark, words)
    assert got["walk"] == ("walk", "VERB", "paradigm") and got["walks"] == ("walk", "VERB", "inflection")
    assert got["walked"] == got["walking"] == ("walk", "VERB", "inflection")
    assert got["running"] == ("run", "VERB", "inflection") and got["run"] == ("run", "NOUN", "none")
    assert got["cities"] == ("city", "NOUN", "inflection") and got["wolves"] == ("wolves", "NOUN", "none")
    assert got["bigger"] == got["biggest"] == ("big", "ADJ", "inflection")
    assert got["larger"] == got["largest"] == ("large", "ADJ", "inflection")
    assert got["teacher"] == ("teacher", "NOUN", "none")  # no "teachest"
    assert got["making"] == ("make", "VERB", "inflection") and got["baked"] == ("bake", "VERB", "inflection")
    assert got["quickly"] == ("quickly", "ADV", "suffix") and got["famous"] == ("famous", "ADJ", "suffix")
    assert got["happiness"][1:] == ("NOUN", "suffix") and got["bus"] == ("bus", "NOUN", "none")
    assert got["sing"] == ("sing", "NOUN", "none") and got["stopped"] == ("stop", "VERB", "inflection")
    assert got["tried"] == got["tries"] == got["trying"] == ("try", "VERB", "inflection") and got["try"][1] == "VERB"
    assert forms(spark, words, [("walks", "stroll", "NOUN")])["walks"] == ("stroll", "NOUN", "table")


def plain(words):
    n = {w: words.count(w) for w in words}
    by_suffix = sorted(((s, p) for p, ss in M.SUFFIXES.items() for s in ss), key=lambda x: (-len(x[0]), x[0]))
    of_suffix = lambda w: next((p for s, p in by_suffix if w.endswith(s) and len(w) >= len(s) + 3), None)
    best = {}
    for w in n:
        found = []
        for i, (suffix, end, pos, also) in enumerate(M.INFLECTIONS):
            if not w.endswith(suffix):
                continue
            stem = w[:len(w) - len(suffix)]
            if end == "~" and not re.search(M.DOUBLED, stem):
                continue
            base = stem[:-1] if end == "~" else stem + end
            if len(base) >= 3 and re.search("[aeiouy]", base) and base in n and (also is None or stem + also in n):
                found.append((n[base], -i, base))
        if found:
            _, i, base = max(found)
            best[w] = (base, -i)
    kinds = {}
    for base, i in best.values():
        if M.INFLECTIONS[i][2] == "VERB":
            kinds.setdefault(base, set()).add(M.INFLECTIONS[i][0] == "ing")
    out = {}
    for w in n:
        base, i = best.get(w, (w, None))
        verb = "VERB" if len(kinds.get(base, ())) == 2 else None
        own = M.INFLECTIONS[i][2] if i is not None else None
        out[w] = (base, own or verb or of_suffix(base) or "NOUN",
                  "inflection" if i is not None else "paradigm" if verb else "suffix" if of_suffix(w) else "none")
    return out


def test_random_words_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    ends = sorted({r[0] for r in M.INFLECTIONS} | {s for ss in M.SUFFIXES.values() for s in ss}) + ["", "", "e", "y", "t"]
    words = ["".join(rnd.choices("abdtey", k=rnd.randint(1, 3))) + rnd.choice(ends) for _ in range(6000)]
    want = plain(words)
    assert forms(spark, words) == want
    assert len({w[2] for w in want.values()}) == 4


def test_apply(spark):
    rows = [(1, ["the", "cities", "walked", "xx"]), (1, ["the", "cities", "walked", "xx"]), (2, None), (3, []), (None, ["walked", None, "walked"])]
    d = spark.createDataFrame(rows, "doc_id int, t array<string>")
    f = spark.createDataFrame([("the", "the", "DET"), ("cities", "city", "NOUN"), ("walked", "walk", "VERB")], "word string, lemma string, pos string")
    got = sorted(str((r["doc_id"], r["lemmas"])) for r in M.apply_forms(d, "t", f).collect())
    assert got == sorted(map(str, [(1, ["city", "walk", "xx"]), (1, ["city", "walk", "xx"]), (2, []), (3, []), (None, ["walk", "walk"])]))
    assert len(LEMMAS) > 50


def test_apply_makes_no_row_of_a_token(spark, monkeypatch):
    """Texts are rewritten block by block, the tokens of a block of any size equal those of a plain loop."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    table = {w: (w[:2] if i % 3 else None, ["NOUN", "DET", "VERB", None][i % 4]) for i, w in enumerate(words[:40])}
    rows = [(i, rnd.choices(words + [None], k=rnd.randint(0, 30))) for i in range(200)] + [(7, None), (None, ["w1"])]
    f = spark.createDataFrame([(w, *x) for w, x in table.items()], "word string, lemma string, pos string")
    d = spark.createDataFrame(rows, "doc_id int, t array<string>").repartition(3)

    def said(ws):
        known = [(table.get(w, (None, None)), w) for w in ws or [] if w is not None]
        return [lem or w for (lem, pos), w in known if (pos or "NOUN") in M.ALLOWED_POS]

    for size in (1 << 18, 50):
        monkeypatch.setattr(M, "BLOCK", size)
        out = M.apply_forms(d, "t", f)
        assert sorted(map(str, [(r[0], r[1]) for r in out.collect()])) == sorted(str((i, said(ws))) for i, ws in rows)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
