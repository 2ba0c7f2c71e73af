"""Byte-pair encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that no vocabulary token holds side by side can never be
merged into one token: between them is a certain cut.  A pretoken is split at
all such pairs, each fragment is encoded by itself, and the ids are put end to
end, which gives the same ids as encoding the pretoken whole.  Fragments recur,
so each Python worker keeps a bounded cache of them.

The vocabulary is a parameter: the path of a ``tokenizers`` JSON file of a
byte-level BPE (ByteLevel pre-tokenizer, no normaliser).  An added token's
string inside a text is that token, as in the library."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the byte-level BPE pretoken pattern of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over texts of ASCII, Latin-1 letters and Latin Extended only, for
#: the standard engine, whose classes agree there.
PLAIN = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
ODD = re.compile("[^\t\n\r\x20-\x7eÀ-ɏ]")
CACHE = 300_000
LONG = 400


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in the vocabulary file: printable bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_symbols()
        raw = {t: bytes(of[c] for c in t) for t in spec["model"]["vocab"] if all(c in of for c in t)}
        self.id = {raw[t]: i for t, i in spec["model"]["vocab"].items() if t in raw}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {self.id[raw[a]] << 20 | self.id[raw[b]]: r for r, (a, b) in enumerate(merges)}
        self.new = [self.id[raw[a] + raw[b]] for a, b in merges]
        self.single = [self.id[bytes([b])] for b in range(256)]
        self.decimal = {i: str(i) for i in self.id.values()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {str(i): b for b, i in self.id.items()} | {str(i): t.encode() for t, i in self.added.items()}
        self.split = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.inside = {t[i:i + 2] for t in self.id for i in range(len(t) - 1)}
        self.pattern, self.plain = regex.compile(PATTERN), re.compile(PLAIN)
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.fragments: dict[bytes, str] = {}

    def cuts(self, piece: bytes) -> list[bytes]:
        """Fragments of a pretoken between certain cuts."""
        out, at, inside = [], 0, self.inside
        for i in range(1, len(piece)):
            if piece[i - 1:i + 1] not in inside:
                out.append(piece[at:i])
                at = i
        out.append(piece[at:])
        return out

    def merge(self, frag: bytes) -> list[int]:
        """Ids of a fragment: merge the lowest-ranked pair, leftmost first, until none is left."""
        if len(frag) > LONG:
            return self._merge_long(frag)
        rank, none, new = self.rank.get, len(self.new), self.new
        parts = [self.single[x] for x in frag]
        ranks = [rank(x << 20 | y, none) for x, y in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i:i + 2] = (new[low],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], none)
        return parts

    def _merge_long(self, frag: bytes) -> list[int]:
        """The same with a heap and linked neighbours: n log n for very long fragments."""
        n, rank = len(frag), self.rank.get
        part = [self.single[x] for x in frag]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or rank(part[i] << 20 | part[j]) != r:
                continue
            part[i], part[j] = self.new[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n and (r := rank(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [p for p in part if p >= 0]

    def _pretoken(self, token: str) -> str:
        """Decimal ids of one pretoken, joined by commas."""
        ids = self.older.get(token)
        if ids is None:
            out = []
            for frag in self.cuts(token.encode()):
                got = self.fragments.get(frag)
                if got is None:
                    got = ",".join([self.decimal[p] for p in self.merge(frag)])
                    if len(frag) <= 16:
                        if len(self.fragments) >= CACHE // 4:
                            self.fragments.clear()
                        self.fragments[frag] = got
                out.append(got)
            ids = ",".join(out)
        if len(token) <= 64:
            if len(self.cache) >= CACHE:  # two generations: what is used stays
                self.older, self.cache = self.cache, {}
            self.cache[token] = ids
        return ids

    def _plain_text(self, text: str, out: list[str]) -> None:
        slow = self._pretoken
        find = self.pattern if ODD.search(text) else self.plain
        if len(text) <= 1 << 20:
            get = self.cache.get
            out.extend([get(t) or slow(t) for t in find.findall(text)])
        else:  # a list of all pretokens of a very long text would not be bounded
            out.extend(self.cache.get(t) or slow(t) for m in find.finditer(text) if (t := m.group()))

    def encode(self, text: str) -> str:
        """Decimal ids of a text, joined by commas; empty text: empty string."""
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            self._plain_text(text[at:m.start()], out)
            out.append(str(self.added[m.group()]))
            at = m.end()
        self._plain_text(text[at:] if at else text, out)
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """Text of comma-joined decimal ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBPE:
    """One per Python worker and vocabulary."""
    return ForcedBPE(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, per row and without a shuffle.

    Returns the ``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if
    ``with_text``, ids (array of int) and decoded.  Null text counts as empty:
    no ids.  Repeated rows, null ids and other columns pass through; other
    columns of the input are not read."""
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    src = docs.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = ", ".join([*(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))),
                        "n_tokens long, ids_sha256 string, decoded_sha256 string"]
                       + ["ids string, decoded string"] * with_text)

    def work(batches):
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for body in pdf["body"]:
                ids = enc.encode(body)
                back = enc.decode(ids)
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                             hashlib.sha256(back.encode()).hexdigest()) + ((ids, back) if with_text else ()))
            more = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:5 if with_text else 3])
            yield pd.concat([pdf.drop(columns="body").reset_index(drop=True), more], axis=1)

    out = src.mapInPandas(work, schema)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"k{i}", c)
    return out.withColumn("ids", _ints("ids")) if with_text else out


def _ints(c: str) -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<int>")).otherwise(F.split(c, ",").cast("array<int>"))
