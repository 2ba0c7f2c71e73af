"""I-Match document fingerprints over randomised lexicons.

Terms (lower-cased runs of letters and digits) are kept if their inverse document
frequency lies in a chosen band, the distinct ones sorted, and hashed once for
each of several random subsets of the lexicon (Chowdhury et al. 2002; Kolcz et
al. 2004).  Subsets come at several rates, each a quarter of the one before, so
that some keep about one term of a short text and others of a long one: where
few terms are left, the share of equal hashes follows the share of common terms.

Document frequencies are counted over all documents, by the terms' 64-bit hashes:
tasks add up what they read, and each range of hashes is summed by one task.  The
terms in the band become a bitmap of ``SPARE`` slots a term (512 KB at least, 64 MB at
most), which is broadcast; where a term outside the band shares a slot with one inside
it counts as inside, in all texts alike."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage, partitions_for, runs
from textlab.llm.rolling import mix64, word_hashes

#: Bits of the smallest and the largest band bitmap, and slots for each term in the band.
TERM_BITS, MOST_BITS = 22, 29
SPARE = 16
#: Terms that a task counts at a time, bytes of text for each range of hashes, terms that a fingerprint handles at a time.
HELD = 1 << 22
RANGE_BYTES = 32 << 20
STEP = 1 << 15
SERIES = 32
LEVELS = 6
MIN_DF = 2
MAX_SHARE = 0.2
PART_BYTES = 16 << 20
U = np.uint64
#: Bytes that do not belong to a term.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEEDS = mix64(np.arange(1, SERIES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
TOPS = np.array([(1 << 64) // 4 ** (l + 1) - 1 for l in range(LEVELS)], U)


def terms(text: str) -> np.ndarray:
    """Distinct terms as sorted hashes."""
    return np.unique(word_hashes(text.encode().lower(), GAP))


def planes(a: np.ndarray) -> bytes:
    """The bytes of sorted numbers by place, which compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def summed(hashes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, n = h[order], n[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    return h[at], np.add.reduceat(n, at) if len(at) else n


def band_terms(docs: DataFrame, text: str, min_df: int, max_share: float) -> tuple[DataFrame, int]:
    """((range, terms, n): the hashes with ln(1 / max_share) <= idf <= ln(documents / min_df) in each range of hashes,
    by :func:`planes`, and their number), bits of a range's number).  Null texts count as empty."""
    spark = docs.sparkSession
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body"))
    documents, size = src.agg(F.count(F.lit(1)), F.sum(F.octet_length("body"))).first()
    bits = min(16, (partitions_for(spark, size or 0, RANGE_BYTES) - 1).bit_length())
    starts = np.arange(1, 1 << bits, dtype=U) << U(64 - bits) if bits else np.zeros(0, U)

    def count(batches):
        held, size = [], 0

        def rows():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(u, starts)
            return pd.DataFrame([(r, planes(h[c == 1]), planes(h[c > 1]), c[c > 1].astype(np.uint32).tobytes())
                                 for r, (h, c) in enumerate(zip(np.split(u, cuts), np.split(n, cuts))) if len(h)],
                                columns=["range", "once", "more", "n"])

        for pdf in batches:
            for body in pdf["body"]:
                held.append(terms(body))
                size += len(held[-1])
                if size > HELD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    def add(batches):
        at, hashes, counts, size = None, [], [], 0

        def row():
            h, n = summed(hashes, counts)
            kept = h[(n >= min_df) & (n <= max_share * documents)]
            return pd.DataFrame({"range": [at], "terms": [planes(kept)], "n": [len(kept)]})

        for (r,), part in runs(batches, ["range"]):
            if at is not None and r != at:
                yield row()
                hashes, counts, size = [], [], 0
            at = r
            for once, more, n in zip(part["once"], part["more"], part["n"]):
                h = [from_planes(once, U), from_planes(more, U)]
                hashes += h
                counts += [np.ones(len(h[0]), np.int64), np.frombuffer(n, np.uint32).astype(np.int64)]
                size += len(h[0]) + len(h[1])
            if size > HELD:
                h, n = summed(hashes, counts)
                hashes, counts, size = [h], [n], 0
        if at is not None:
            yield row()

    parts = src.mapInPandas(count, "range int, once binary, more binary, n binary").repartitionById(1 << bits, F.col("range"))
    return cut_lineage(parts.sortWithinPartitions("range").mapInPandas(add, "range int, terms binary, n long")), bits


def lexicon_of(docs: DataFrame, text: str = "text", min_df: int = MIN_DF, max_share: float = MAX_SHARE) -> np.ndarray:
    """Bitmap of the terms in the band, by the first bits of their hashes."""
    kept, range_bits = band_terms(docs, text, min_df, max_share)
    n = kept.agg(F.sum("n")).first()[0] or 0
    bits = int(min(MOST_BITS, max(TERM_BITS, (SPARE * n).bit_length())))
    width = 1 << (bits - range_bits)

    def draw(batches):
        for pdf in batches:
            for r, raw in zip(pdf["range"], pdf["terms"]):
                part = np.zeros(width, bool)
                part[classes(from_planes(raw, U), bits) - r * width] = True
                yield pd.DataFrame({"range": [r], "bits": [np.packbits(part).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in kept.where("n > 0").mapInPandas(draw, "range int, bits binary").toLocalIterator():  # the bitmap in parts
        out[r["range"] * width // 8:(r["range"] + 1) * width // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def classes(t: np.ndarray, bits: int) -> np.ndarray:
    return (t >> U(64 - bits)).astype(np.int64)


def fingerprint(text: str, lexicon: np.ndarray) -> np.ndarray:
    """LEVELS x SERIES 16-bit hashes, 0 where no term of the subset occurs.  A text
    without a term in the band uses all its terms, without any term itself as one."""
    t = terms(text)
    c = classes(t, (8 * len(lexicon)).bit_length() - 1)
    kept = t[(lexicon[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1] if len(t) else t
    if not len(kept):
        kept = t if len(t) else np.frombuffer(hashlib.sha256(text.encode()).digest()[:8], U)
    total, some = np.zeros((LEVELS, SERIES), U), np.zeros((LEVELS, SERIES), bool)
    for at in range(0, len(kept), STEP):
        # one value of a term per series by double hashing; its share of a subset's hash is the same in all
        v = mix64(kept[at:at + STEP])
        h = v[:, None] + mix64(v)[:, None] * SEEDS[None, :]
        for l in range(LEVELS):
            member = h <= TOPS[l]
            live = member.any(axis=1)
            h, v, member = h[live], v[live], member[live]  # rarer subsets are parts of the commoner ones
            if not len(h):
                break
            some[l] |= member.any(axis=0)
            total[l] += (member * v[:, None]).sum(axis=0, dtype=U)
    return np.where(some, mix64(total) % U(65535) + U(1), U(0)).astype(np.uint16)


def shown(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal hashes among those that either text has, on the rarest level
    that at least half of the series reach and the level after it; equal
    fingerprints: 1."""
    if (x == y).all():
        return 1.0
    some = (x > 0) | (y > 0)
    full = np.flatnonzero(some.sum(axis=1) * 2 >= SERIES)
    l = int(full[-1]) if len(full) else 0
    at = some[l:l + 2]
    return float(((x == y)[l:l + 2] & at).sum() / at.sum()) if at.any() else 0.0


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_df: int = MIN_DF,
                 max_share: float = MAX_SHARE) -> DataFrame:
    """Fingerprint every text and its edited text: the last floor(n / 2) code
    points replaced by as many (or all) first ones of the next document by
    descending id; after the last comes the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row.  Null texts are empty; rows
    without an id come last, repeated ids in order of their texts' hash; a table
    of one row is its own next.  An empty table gives an empty result."""
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs, text, min_df, max_share))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    size, = src.agg(F.sum(F.octet_length("body"))).first()
    parts = partitions_for(spark, size or 0, PART_BYTES)
    # bounds are ids of documents: each is the first of its part, and its text also
    # goes to the part before it, whose last document it follows
    got = src.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [1.0], 10_000)).first()
    ends = np.array(sorted({*(got[1] or []), got[0]} - {None}), np.int64)
    n = max(1, len(ends))

    @F.pandas_udf("array<struct<part:int,kind:int>>")
    def placed(ids: pd.Series) -> pd.Series:
        out = []
        for d in ids.astype("object"):
            if d is None or pd.isna(d):
                out.append([{"part": 0, "kind": 0}])
                continue
            p = int(np.searchsorted(ends, int(d)))
            out.append([{"part": p, "kind": 0}, *([{"part": (p + 1) % n, "kind": 1}] if ends[p] == int(d) else [])])
        return pd.Series(out)

    def work(batches):
        lex, held, first, at, over = lexicon.value, None, None, None, False
        rows: list[tuple] = []

        def finish(this, after):
            d, body, fp = this
            half = len(body) // 2
            edited = body[:len(body) - half] + after[1][:half]
            fe = fingerprint(edited, lex)
            rows.append((d, len(body), hashlib.sha256(edited.encode()).hexdigest(), shown(fp), shown(fe),
                         likeness(fp, fe), likeness(fp, after[2])))

        def frame():
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            rows.clear()
            return out.astype({"doc_id": "Int64"})

        for (p,), part in runs(batches, ["part"]):
            if p != at:
                if held:
                    finish(held, first)
                held, first, at, over = None, None, p, False
            for d, kind, body in zip(part["doc_id"].astype("Int64").astype(object), part["kind"], part["body"]):
                if over:
                    continue
                this = (None if d is pd.NA else d, body, fingerprint(body, lex))
                if held:
                    finish(held, this)
                first = first or this
                over = kind == 1
                held = None if over else this
            yield frame()
        if held:  # a part without a follower: the only one, without ids
            finish(held, first)
        if rows:
            yield frame()

    dealt = (src.withColumn("h", F.xxhash64("body")).withColumn("to", F.explode(placed("doc_id")))
             .select("to.part", "to.kind", "doc_id", "h", "body").repartitionById(n, F.col("part")))
    return (dealt.sortWithinPartitions("part", "kind", F.desc_nulls_last("doc_id"), "h", "body")
            .select("part", "kind", "doc_id", "body")
            .mapInPandas(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                               "near_edited double, near_next double"))
