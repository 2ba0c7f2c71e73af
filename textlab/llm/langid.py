"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot s holds one bit for each
language, so the AND of an n-gram's slots returns all languages that hold the
n-gram.  A text's n-grams are looked up, the hits counted per language, the
counts corrected for each filter's false positives, and the largest decides.

Learning counts the n-grams of all training texts per language (no sample); an
n-gram belongs to every language in which it is at least ``1 / NEAR`` as frequent
as in the language where it is most frequent and not rarer than ``RARE`` of that
language's n-grams.  The filter has ``SPARE`` slots for each n-gram of the largest
language, counted before.  It is broadcast; where it would exceed ``MOST_BYTES`` it is
cut into slices by the n-grams' first hash bits, which are built and broadcast one
after the other: each answers the n-grams of its slice, corrected for its own false
positives, and a text's answers add up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage, runs
from textlab.llm.rolling import mix64

N = 4
#: Slots of the smallest filter, slots per n-gram, and bytes of the largest filter.
SLOTS = 1 << 22
SPARE = 8
MOST_BYTES = 1 << 26
HASHES = 2
NEAR = 4.0
#: Least count of an n-gram in all languages, and its least share of a language's
#: n-grams.  A count alone would take every typing error once a language is large.
MIN_COUNT = 3
RARE = 1e-8
CHUNK = 1 << 16
PIECE = 1 << 20
UNKNOWN = "und"


def _alphabet() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    out[letters] = letters
    return out


_letters = None


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of all character n-grams of the lower-cased text (runs of other
    characters count as one gap, which also begins and ends it) and whether it
    has a letter.  n-grams need two letters at least."""
    global _letters
    if _letters is None:
        _letters = _alphabet()
    text, out, weak, any_letter = text.lower(), [], [], False
    held = np.zeros(1, np.uint32)  # the symbols before a piece that its first n-grams begin with
    for at in range(0, max(len(text), 1), PIECE):
        last = at + PIECE >= len(text)
        points = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate([held, _letters[points], np.zeros(int(last), np.uint32)])
        gap = s == 0
        s = s[~(gap & np.r_[False, gap[:-1]])]  # gaps are merged first, so pieces overlap by symbols that count
        any_letter = any_letter or bool(s.any())
        if last and len(s) < N and not (out or weak):
            # a text shorter than an n-gram is one n-gram, filled up with gaps
            s = np.concatenate([s, np.zeros(N - len(s), np.uint32)])
        held = s[-(N - 1):]
        if len(s) < N:
            continue
        h = np.zeros(len(s) - N + 1, np.uint64)
        k = np.zeros(len(h), np.int8)
        for i in range(N):
            part = s[i:len(h) + i]
            h = (h << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) + h + part
            k += part != 0
        if (k >= 2).any():
            out.append(mix64(h[k >= 2]))
        elif not out:
            weak.append(mix64(h))  # count only where the whole text has no other
    out = out or weak
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), any_letter


def slots(h: np.ndarray, size: int):
    """The slots of each hash in a filter of so many (a power of two), one array after another."""
    width = size.bit_length() - 1
    for i in range(HASHES):
        yield ((h >> np.uint64(i * width + 1)) % np.uint64(size)).astype(np.int64)


def slots_for(keys: int, planes: int = 1) -> int:
    """Slots of a filter that holds so many n-grams of one language: SLOTS, or
    more where they need it, or fewer where many planes would exceed MOST_BYTES."""
    need = max(CHUNK, 1 << (SPARE * max(keys, 1) - 1).bit_length())
    size = max(SLOTS, need)
    while size > need and size * planes > MOST_BYTES:
        size //= 2
    return size


def slices_for(most, planes: int) -> int:
    """Slices (a power of two) that keep a filter within MOST_BYTES; ``most(n)`` gives the
    n-grams of one language in the fullest of n slices."""
    n = 1
    while (size := slots_for(most(n), planes)) * planes > MOST_BYTES and size > CHUNK:
        n *= 2
    return n


def slice_of(h: np.ndarray, n: int) -> np.ndarray:
    """The slice of each hash: its first bits.  Slots of a filter of up to 2**26 take bits below the first 11."""
    return h >> np.uint64(64 - (n.bit_length() - 1)) if n > 1 else np.zeros(len(h), np.uint64)


def slice_column(n: int) -> Column:
    """:func:`slice_of` for a column of signed hashes."""
    return F.shiftrightunsigned(F.col("gram"), 64 - (n.bit_length() - 1)) if n > 1 else F.lit(0).cast("long")


def found(bits: np.ndarray, h: np.ndarray, languages: int) -> np.ndarray:
    """How many of the n-grams each language's filter holds."""
    mask = None
    for s in slots(h, len(bits)):
        mask = bits[s] if mask is None else mask & bits[s]
    counts = np.array([np.bincount(mask[:, p], minlength=256) for p in range(mask.shape[1])])
    values = np.arange(256)
    return np.array([counts[i // 8][(values >> (i % 8)) & 1 == 1].sum() for i in range(languages)])


def false_rates(bits: np.ndarray, languages: int) -> np.ndarray:
    return np.array([(bits[:, i // 8] >> (i % 8) & 1).mean() for i in range(languages)]) ** HASHES


def corrected(got: np.ndarray, n: int, false: np.ndarray) -> np.ndarray:
    """The n-grams that languages hold, without the filters' expected false positives."""
    # a full filter says nothing
    return np.where(false < 0.999, (got - n * false) / np.maximum(1 - false, 0.001), 0.0)


@dataclass
class LanguageModel:
    """Bit-sliced filters: ``bits[slot, l // 8]`` has bit l % 8 for language l.  A model
    of several slices has ``bits`` None and the n-grams as ``table`` (gram, ls), of which
    :func:`predict` makes one filter of ``size`` slots after the other."""
    languages: list[str]
    bits: np.ndarray | None
    totals: list[int]
    table: DataFrame | None = None
    slices: int = 1
    size: int = 0

    def __post_init__(self):
        self.false = false_rates(self.bits, len(self.languages)) if self.bits is not None else None

    def decide(self, text: str) -> tuple[str, float, int]:
        """Language, score (the corrected share of n-grams that its filter holds)
        and number of n-grams.  A tie goes to the language with more training
        text, as when no filter holds anything."""
        h, letter = grams(text)
        if not letter or not self.languages:
            return UNKNOWN, 0.0, 0
        if self.bits is None:
            raise ValueError("this model has several slices: predict() goes through them")
        return self.choose(corrected(found(self.bits, h, len(self.languages)), len(h), self.false), len(h))

    def choose(self, true: np.ndarray, n: int) -> tuple[str, float, int]:
        """The answer for a text of which each language holds ``true`` of n n-grams."""
        true = np.maximum(true / n, 0)
        best = max(range(len(true)), key=lambda i: (true[i], self.totals[i], -i))
        return self.languages[best], float(min(1.0, true[best])), n


def _filter(kept: DataFrame, size: int, planes: int) -> np.ndarray:
    """The bit-sliced filter of some n-grams; size x planes bytes come to the driver, MOST_BYTES at most."""
    def fill(batches):
        part = np.zeros((size, planes), np.uint8)
        for pdf in batches:
            h = pdf["gram"].to_numpy().view(np.uint64)
            mask = np.zeros((len(h), planes), np.uint8)
            sizes = pdf["ls"].map(len).to_numpy()
            ls = np.concatenate(pdf["ls"].to_list()) if len(pdf) else np.zeros(0, int)
            np.bitwise_or.at(mask, (np.repeat(np.arange(len(h)), sizes), ls // 8), (1 << (ls % 8)).astype(np.uint8))
            for s in slots(h, size):
                np.bitwise_or.at(part, s, mask)
        for c in range(size // CHUNK):
            block = part[c * CHUNK:(c + 1) * CHUNK]
            if block.any():
                yield pd.DataFrame({"chunk": [c], "block": [block.tobytes()]})

    def union(batches):
        held, block = None, None
        for (c,), part in runs(batches, ["chunk"]):
            if held is not None and c != held:
                yield pd.DataFrame({"chunk": [held], "block": [block.tobytes()]})
                block = None
            held = c
            for raw in part["block"]:
                b = np.frombuffer(raw, np.uint8)
                block = b.copy() if block is None else block | b
        if held is not None:
            yield pd.DataFrame({"chunk": [held], "block": [block.tobytes()]})

    schema = "chunk int, block binary"
    bits = np.zeros((size, planes), np.uint8)
    rows = (kept.select("gram", "ls").mapInPandas(fill, schema).repartition("chunk").sortWithinPartitions("chunk")
            .mapInPandas(union, schema))
    for r in rows.toLocalIterator():
        bits[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["block"]), np.uint8).reshape(-1, planes)
    return bits


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from every row with text and language; other rows are left out.
    No such row: a model without languages, which answers ``und``."""
    spark = docs.sparkSession
    src = docs.select(F.col(text).alias("body"), F.col(lang).alias("lang")).where("body is not null and lang is not null")
    languages = sorted(r[0] for r in src.select("lang").distinct().toLocalIterator())
    planes = max(1, -(-len(languages) // 8))
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, planes), np.uint8), [])
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        for pdf in batches:
            for name, part in pdf.groupby("lang")["body"]:
                # unique now and then, so that memory follows the piece and not the batch
                held, size = [], 0
                for body in [*part, None]:
                    if body is not None:
                        g, letter = grams(body)
                        if letter:
                            held.append(g)
                            size += len(g)
                    if held and (body is None or size > 4_000_000):
                        u, n = np.unique(np.concatenate(held), return_counts=True)
                        yield pd.DataFrame({"l": index[name], "gram": u.view(np.int64), "n": n})
                        held, size = [], 0

    counts = cut_lineage(src.mapInPandas(count, "l int, gram long, n long")
                         .groupBy("l", "gram").agg(F.sum("n").alias("n")))
    totals = dict(counts.groupBy("l").agg(F.sum("n")).toLocalIterator())
    share = F.col("n") / F.element_at(F.lit([float(totals.get(i, 1)) for i in range(len(languages))]), F.col("l") + 1)
    top = counts.withColumn("f", share).groupBy("gram").agg(
        F.max("f").alias("top"), F.sum("n").alias("n"), F.collect_list(F.struct("l", "f")).alias("by"))
    # at most one entry per language in "by"
    kept = cut_lineage(top.where((F.col("n") >= MIN_COUNT) & (F.col("top") >= RARE))
                       .select("gram", "n", F.filter("by", lambda x: (x["f"] * NEAR >= F.col("top")) & (x["f"] >= RARE))["l"].alias("ls")))

    def most(n):
        per = kept.select(slice_column(n).alias("s"), F.explode("ls").alias("l")).groupBy("s", "l").count()
        return per.agg(F.max("count")).first()[0] or 0

    slices = slices_for(most, planes)
    size = slots_for(most(slices), planes)
    totals = [int(totals.get(i, 0)) for i in range(len(languages))]
    if slices > 1:
        return LanguageModel(languages, None, totals, kept, slices, size)
    return LanguageModel(languages, _filter(kept, size, planes), totals)


def _by_slices(docs: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """(key, p) for every distinct text's md5: one pass over the texts for each slice of the
    filter, whose corrected counts add up.  Every pass is written."""
    spark, many = docs.sparkSession, len(model.languages)
    planes = max(1, -(-many // 8))
    src = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias("key"), F.col(text).alias("body"))
    answers = None
    for s in range(model.slices):
        bits = _filter(model.table.where(slice_column(model.slices) == s), model.size, planes)
        shared = spark.sparkContext.broadcast((bits, false_rates(bits, many)))

        def count(batches, s=s, shared=shared):
            bits, false = shared.value
            for pdf in batches:
                out = []
                for key, body in zip(pdf["key"], pdf["body"]):
                    h, letter = grams(body)
                    h = h[slice_of(h, model_slices) == s] if letter else h[:0]
                    if len(h):
                        out.append((key, len(h), corrected(found(bits, h, many), len(h), false)))
                if out:
                    yield pd.DataFrame(out, columns=["key", "n", "held"])

        model_slices = model.slices
        # equal texts give equal rows, of which one stays
        rows = cut_lineage(src.mapInPandas(count, "key string, n long, held array<double>").dropDuplicates(["key"]))
        shared.destroy()
        answers = rows if answers is None else answers.unionByName(rows)
    sums = answers.groupBy("key").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("held", F.lit(i))) for i in range(many)]).alias("held"))
    plain = LanguageModel(model.languages, None, model.totals)

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def decide(n: pd.Series, held: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plain.choose(np.asarray(h, float), int(k)) for k, h in zip(n, held)], columns=["lang_pred", "score", "n_grams"])

    return sums.select("key", decide("n", "held").alias("p"))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``n_grams`` (same-named columns of the
    input are replaced).  Null text, or text without a letter: ``und``, score 0."""
    names = ["lang_pred", "score", "n_grams"]
    rest = [F.col(f"d.{c}") for c in docs.columns if c not in names]
    if model.table is not None:
        answers = _by_slices(docs, model, text)
        p = F.coalesce("p", F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_grams")))
        return (docs.select(F.struct(*docs.columns).alias("d"), F.md5(text).alias("key")).join(answers, "key", "left")
                .select("d", p.alias("p")).select(*rest, *[F.col(f"p.{c}") for c in names]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_BYTES at most

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def decide(bodies: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.decide(b) if b is not None else (UNKNOWN, 0.0, 0) for b in bodies],
                            columns=["lang_pred", "score", "n_grams"])

    return (docs.select(F.struct(*docs.columns).alias("d"), decide(F.col(text)).alias("p"))
            .select(*rest, *[F.col(f"p.{c}") for c in names]))


def bucket(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; 0 where the id is null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % m, F.lit(0))
