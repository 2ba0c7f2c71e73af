import hashlib
import itertools
import random
import re
import zlib

import pytest

from textlab.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, seen string, kind int, cost string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired text) of the best of all edits of a few messages."""
    kinds, best = faults(rows), None
    n = len(rows)
    choice = ["K", "Ru", "Ra", "D"]
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for picks in itertools.product(choice, repeat=n):
        if any(k in ("blank", "duplicate") and p != "D" for k, p in zip(kinds, picks)):
            continue
        cost = sum({"K": 0, "D": 3}.get(p, 2) + (p != "D" and k == "truncated") for k, p in zip(kinds, picks))
        for ins in itertools.product(gaps, repeat=n + 1):
            total = cost + 2 * sum(map(len, ins))
            if best and total > best[0]:
                continue
            audit, initials, said = "", "", []
            for i in range(n + 1):
                for x in ins[i]:
                    audit, initials = audit + "I", initials + x
                    said.append({"u": "user:", "a": "assistant:"}[x])
                if i < n:
                    role, text = rows[i]
                    audit += picks[i][0]
                    if picks[i] != "D":
                        role = {"Ru": "user", "Ra": "assistant"}.get(picks[i], role)
                        initials += role[:1] or "?"
                        said.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (total, audit) < best[:2]):
                best = total, audit, "\n".join(said)
    return best


def run(rows):
    conv, seen, got = repair.Conversation(), set(), []
    for i, (role, text) in enumerate(rows):
        got += conv.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    got += conv.end()
    said = "\n".join(f"{r}:{t}" for x, r, t in got if x != "D")
    assert conv.sha.hexdigest() == hashlib.sha256(said.encode()).hexdigest()
    assert "".join(x for x, _, _ in got) == "".join(conv.audit)
    return conv.cost, "".join(conv.audit), said


def some(rng, n):
    roles = ["user", "assistant", "system", "tool", " ", "", "uma", "sys"]
    texts = ["Yes.", "Why?", "cut off", "", " \t", "No!", "Ünd.", "and ."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_small_conversations_equal_all_edits():
    rng = random.Random(1)
    for i in range(120):
        rows = some(rng, 1 + i % 4)
        assert run(rows) == brute(rows), rows


def plain(rows):
    """Dijkstra-free reference: best (cost, audit) of every state by tuples."""
    kinds, inf = faults(rows), None
    best = {0: (0, "")}

    def insert(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                x = (c + 2, a + "I")
                if to not in best or x < best[to]:
                    best[to] = x
        return best

    best = insert(best)
    for (role, _), kind in zip(rows, kinds):
        new = {}

        def offer(s, x):
            if s not in new or x < new[s]:
                new[s] = x

        for s, (c, a) in best.items():
            offer(s, (c + 3, a + "D"))
            if kind not in ("blank", "duplicate"):
                t = kind == "truncated"
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                if to is not None:
                    offer(to, (c + t, a + "K"))
                offer({0: 2, 1: 2, 2: 3, 3: 2}[s], (c + 2 + t, a + "R"))
        best = insert(new)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("window", [1, 2, 64])
def test_windows_do_not_change_the_result(monkeypatch, window):
    monkeypatch.setattr(repair, "WINDOW", window)
    rng = random.Random(window)
    for n in (1, 5, 40, 400):
        for _ in range(10):
            rows = [(r, t + str(i) * (rng.random() < 0.7)) for i, (r, t) in enumerate(some(rng, n))]
            assert run(rows)[:2] == plain(rows)


def test_numbers_stay_short():
    conv = repair.Conversation()
    for i in range(20_000):
        list(conv.add(i, ("user", "assistant", "user")[i % 3], f"Text {i}.", False))
        assert len(conv.waiting) <= 2 * repair.WINDOW
        assert max(conv.paths.weight.values()).bit_length() < 4000


def crc_kind(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def whole(rows):
    """Everything that repair returns, from damaged rows of plain Python."""
    damaged, ids = [], {r[0] for r in rows}
    for c, t, role, text in (r[:4] for r in rows):
        kind, role, text = crc_kind(c, t), " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        damaged += [row] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c in ids:
        mine = sorted((r[1:] for r in damaged if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [r[1:] for r in mine]
        turns = {r[0] for r in mine if r[0] is not None}
        kinds = faults(said)
        cost, audit, text = run(said) if said else (0, "", "")
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
                    cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed=4):
    rng, rows = random.Random(seed), []
    for c in [*range(60), None]:
        for i, (role, text) in enumerate(some(rng, rng.randrange(0, 9))):
            turn = None if rng.random() < 0.05 else i + (rng.random() < 0.1)
            rows.append((c, turn, None if rng.random() < 0.05 else role, None if rng.random() < 0.05 else text, "x", 1, "y"))
    rows += [rows[7], rows[7]]  # a repeated row
    rows += [(70, i, ("user", "assistant")[i % 2], f"long {i} " * 2000 + ".", None, None, None) for i in range(300)]
    rows.append((71, 0, "user", "w" * 2_000_000 + "!", None, None, None))
    return rows


def test_whole_tables(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = repair.repair(repair.damage(df), df).collect()
    assert sorted((tuple(r) for r in got), key=str) == whole(rows)


def test_edits_give_the_repaired_messages(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    damaged = repair.damage(df)
    said = {}
    for r in sorted(repair.edits(damaged).collect(), key=lambda r: r.place):
        said.setdefault(r.conv_id, []).append(r)
    for r in repair.repair(damaged, df).collect():
        mine = said.get(r.conv_id, [])
        assert "".join(x.edit for x in mine) == r.audit and [x.place for x in mine] == list(range(len(mine)))
        text = "\n".join(f"{x.role}:{x.text}" for x in mine if x.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(df), df).collect() == []
