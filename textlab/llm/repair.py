"""Repair of the structure of conversations by a shortest path over big integers.

Every message of a conversation is kept, given another role or deleted, and empty
messages may be put in, until the initials of the roles read ``(s?(ua)+)?``.  The
states are what has been read so far: nothing, ``s``, ``..u`` or ``..ua``; the
messages in order and the four states are the nodes of a directed acyclic graph.

A path's weight is one integer.  Its high digits hold the cost; below them stands
one three-bit digit for each place of the audit, filled from the left with the
letters of the edits (D 1, I 2, K 3, R 4) and with zeros behind the end.  Adding an
edge adds its cost and its letter at the path's next place, and the least integer
of a node is the cheapest path, of equally cheap ones that with the ASCII-least
audit, a shorter audit standing before its continuations.  Nothing else decides:
states follow from the letters, so the audit is read off the digits and no links
back are stored.  (One integer a node is enough: if the audit of one of two equally
cheap paths to a node began the other's, the other would have insertions left over
and cost more; so they differ at some place, and no continuation changes their order.)

The numbers stay short however long a conversation is.  Every ``WINDOW`` messages
paths that no continuation can make the best go (``GAP`` bounds what one state can
gain on another), the letters on which the rest agree are final and leave the
numbers, and the places start anew.  So a conversation streams through its task:
the messages whose letters are open are held, and the hashes or rows of the others
are out."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
NOTHING, S, U, UA = range(4)
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
#: Cost of an edit; a truncated message that stays costs one more.
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Role initial -> next state, by state.
READ = {NOTHING: {"s": S, "u": U}, S: {"u": U}, U: {"a": UA}, UA: {"u": U}}
ROLE = {NOTHING: "user", S: "user", U: "assistant", UA: "user"}
#: No state can lose more than this against another one, whatever follows: from ``..ua`` a
#: message ``s`` that "nothing" would keep is deleted (3), and getting there takes an insertion (2).
GAP = 5
WINDOW = 64
DIGIT = 3


class Paths:
    """The least path of every state that is alive, as one integer each."""

    def __init__(self):
        self.paid = 0  # cost of the part that is final
        self._start({NOTHING: (0, ())})
        self._insert()

    def _start(self, alive: dict[int, tuple[int, tuple]]) -> None:
        """Anew from (cost, open letters) of each state."""
        self.places = max(len(x) for _, x in alive.values()) + 3 * WINDOW + 2
        self.high = DIGIT * self.places
        self.rows, self.weight, self.used = 0, {}, {}
        for state, (cost, letters) in alive.items():
            w = cost << self.high
            for i, x in enumerate(letters):
                w |= x << self.high - DIGIT * (i + 1)
            self.weight[state], self.used[state] = w, len(letters)

    def _edge(self, state: int, letter: int, more: int = 0) -> int:
        return self.weight[state] + ((COSTS[letter] + more) << self.high) + (letter << self.high - DIGIT * (self.used[state] + 1))

    def _insert(self) -> None:
        for _ in range(2):  # nothing -> ..u -> ..ua is the longest chain that can pay
            for state in sorted(self.weight):
                to = READ[state][ROLE[state][0]]
                w = self._edge(state, INSERT)
                if w < self.weight.get(to, w + 1):
                    self.weight[to], self.used[to] = w, self.used[state] + 1

    def message(self, initial: str, stays: bool, truncated: bool) -> None:
        """One message more; ``stays`` is false where it has to be deleted."""
        best: dict[int, tuple[int, int]] = {}

        def offer(to, w, n):
            if to not in best or w < best[to][0]:
                best[to] = w, n

        for state in self.weight:
            n = self.used[state] + 1
            offer(state, self._edge(state, DELETE), n)
            if stays:
                if initial in READ[state]:
                    offer(READ[state][initial], self._edge(state, KEEP, truncated), n)
                offer(READ[state][ROLE[state][0]], self._edge(state, REROLE, truncated), n)
        self.weight = {s: w for s, (w, _) in best.items()}
        self.used = {s: n for s, (_, n) in best.items()}
        self._insert()
        self.rows += 1

    def _open(self, state: int) -> tuple[int, tuple]:
        w, n = self.weight[state], self.used[state]
        return w >> self.high, tuple(w >> self.high - DIGIT * (i + 1) & 7 for i in range(n))

    def settle(self) -> tuple:
        """The letters that are final now; to be called every ``WINDOW`` messages."""
        if self.rows < WINDOW:
            return ()
        alive = {s: self._open(s) for s in self.weight}
        least = min(c for c, _ in alive.values())
        alive = {s: x for s, x in alive.items() if x[0] <= least + GAP}
        agreed = 0
        for places in zip(*(x for _, x in alive.values())):
            if len(set(places)) > 1:
                break
            agreed += 1
        final = next(iter(alive.values()))[1][:agreed]
        self.paid += least
        self._start({s: (c - least, x[agreed:]) for s, (c, x) in alive.items()})
        return final

    def end(self) -> tuple[int, tuple]:
        """Cost of the best path and its open letters."""
        w, state = min((self.weight[s], s) for s in (NOTHING, UA) if s in self.weight)
        cost, letters = self._open(state)
        return self.paid + cost, letters


class Conversation:
    """One conversation, message by message in order."""

    def __init__(self):
        self.paths, self.state = Paths(), NOTHING
        self.waiting: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.last, self.before = 0, None, None, None

    def add(self, turn, role: str, text: str, seen: bool) -> Iterator[tuple]:
        """``seen``: the same role and text came before.  Yields the edits that are final: (letter, role, text)."""
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial, body = role[:1], text.strip(SPACE)
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        fault = "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        self.waiting.append((role, text))
        self.paths.message(initial, fault not in ("blank", "duplicate"), fault == "truncated")
        yield from self._apply(self.paths.settle())

    def _apply(self, letters) -> Iterator[tuple]:
        for x in letters:
            role, text = (ROLE[self.state], "") if x == INSERT else self.waiting.popleft()
            if x == REROLE:
                role = ROLE[self.state]
            self.audit.append(LETTERS[x])
            if x != DELETE:
                self.state = READ[self.state][role[0]]
                self.sha.update(("\n" * self.begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                self.begun = True
            yield LETTERS[x], role, text

    def end(self) -> Iterator[tuple]:
        self.cost, letters = self.paths.end()
        yield from self._apply(letters)
        self.gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, place long, edit string, role string, text string"


def _ordered(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Messages in order within their task, with ``seen``: role and text came before in the conversation."""
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return (rows.withColumn("seen", F.row_number().over(same) > 1).withColumn("own", F.col("conv_id").isNotNull())
            .repartition("conv_id", "own").sortWithinPartitions("own", "conv_id", F.asc_nulls_first("turn"), "role", "text", "seen"))


def _walk(rows: DataFrame, schema: str, edits: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        at, conv, place, out = None, None, 0, []

        def show(found):
            nonlocal place
            for letter, role, text in found:
                if edits:
                    out.append((at[0], place, letter, role, text))
                place += 1

        def finish():
            show(conv.end())
            if not edits:
                out.append((at[0], conv.gaps, *conv.counts.values(), conv.cost, "".join(conv.audit), conv.sha.hexdigest()))

        def frame():
            got = pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
            out.clear()
            return got

        for pdf in batches:
            ids, turns = (pdf[c].astype("Int64").astype(object) for c in ("conv_id", "turn"))
            for c, t, role, text, seen in zip(ids, turns, pdf["role"], pdf["text"], pdf["seen"]):
                key = (None if c is pd.NA else int(c),)
                if key != at:
                    if conv:
                        finish()
                    at, conv, place = key, Conversation(), 0
                show(conv.add(None if t is pd.NA else int(t), role, text, bool(seen)))
            if out:
                yield frame()
        if conv:
            finish()
        if out:
            yield frame()

    return rows.mapInPandas(work, schema)


def repair(messages: DataFrame, ids: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row for every distinct conversation of ``ids``: gaps, blank, duplicate, truncated,
    illegal, cost, audit (the letters of the cheapest edits) and repaired_sha256 (of the repaired
    messages as ``role:text``, joined by newlines).

    Messages are taken by turn, those without one first, then by role and text.  A message's
    first fault counts: blank (white space only), duplicate (role and text came before),
    truncated (the last character that is not white space is none of ``.!?``).  Blank and
    duplicate messages have to go.  ``gaps`` counts the turn numbers that are missing between
    the least and the largest; ``illegal`` the neighbours whose roles do not begin with su, ua or au.

    Null role or text counts as one space; rows without a conv_id are one conversation, without
    an id.  A conversation without messages has zeros, an empty audit and the hash of nothing.
    A conversation's messages stream through one task, as its hash is one chain: the task holds
    the audit and the messages whose edit is open, whatever their number.  Other columns are not read."""
    rows = _walk(_ordered(messages, conv_id, turn, role, text), SUMMARY, False)
    every = ids.select(F.col(conv_id).cast("long").alias("id")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(rows, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


def edits(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The cheapest edits themselves: conv_id, place, edit (D, I, K or R), role and text (of a
    deleted message its own; of the others what the repaired conversation holds).  See :func:`repair`."""
    return _walk(_ordered(messages, conv_id, turn, role, text), EDITS, True)


def damage(messages: DataFrame) -> DataFrame:
    """Damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes
    the text's ``.!?``, 3 repeats the row, 4 sets the role user.  Nulls stand for one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (messages.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                            kind.alias("kind"))
            .where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("kind", "copy"))
