"""Near-duplicate documents by SuperMinHash signatures, banding, verification on
full shingle sets and connected components.

SuperMinHash (Ertl 2017): every shingle draws a random permutation of the
signature's slots; slot ``p[j]`` gets the rank ``j`` plus a uniform fraction, and
keeps the least value of all shingles.  The ranks of one shingle are correlated
(each slot gets another one), which lowers the variance of the estimate.  Here
the draws run rank by rank for all shingles at once and stop as soon as no slot
can improve, for long texts after the first rank or two.

Candidates share a band.  A bucket is never expanded into all its pairs:

1. documents with equal shingle sets are one node;
2. star round: every member of a bucket against the bucket's smallest node, on
   full sets, and components of the links found;
3. rest round: in buckets that still hold several components, members outside the
   largest component against all members, block by block, on full sets.  So every
   pair that shares a band is linked, rejected, or already connected."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import bit_filter, bits_for, components, cut_lineage, runs, slot_rows, slots_of, with_bit
from textlab.llm.rolling import mix64, shingle_hashes, word_hashes

SALT = 64
BLOCK = 256
U = np.uint64


def signature(shingles: np.ndarray, m: int) -> np.ndarray:
    """m slot values: rank << 32 | fraction of the least draw."""
    best = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    n, perm, rows = len(shingles), None, None
    for j in range(m if n else 0):
        draw = mix64(shingles + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (((draw & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if perm is None:
                rows = np.arange(n)
                perm = np.tile(np.arange(m, dtype=np.uint16), (n, 1))
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(best, slot, U(j << 32) | (draw >> U(32)))
        if best.max() < U((j + 1) << 32):
            break
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    h = np.arange(len(sig) // rows, dtype=U) * U(0xA24BAED4963EE407)
    for r in range(rows):
        h = mix64(h ^ sig[r::rows][:len(h)])
    return h


def shingles_of(text: str, k: int) -> np.ndarray:
    return shingle_hashes(word_hashes(text.encode().lower()), k)


def _signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    also = [c for c in docs.columns if c not in ("doc_id", "body")]  # whole numbers that stay with their row

    def work(batches):
        for pdf in batches:
            out = []
            for body in pdf["body"]:
                s = shingles_of(body, k)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append((len(s), key, band_keys(signature(s, bands * rows), rows).view(np.int64) if len(s) else None))
            more = pd.DataFrame(out, columns=["n_shingles", "node", "bands"])
            yield pd.concat([pdf[["doc_id", *also]].astype("Int64").reset_index(drop=True), more], axis=1)

    return docs.mapInPandas(work, ", ".join(f"{c} long" for c in ["doc_id", *also, "n_shingles", "node"]) + ", bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id).  A bitmap of fixed size over
    the ids lets through a superset, the join keeps what is wanted."""
    wanted = cut_lineage(wanted)
    bits = bits_for(wanted.count())

    def mark(batches):
        for pdf in batches:
            yield slot_rows(slots_of(mix64(pdf["doc_id"].to_numpy().view(U)), bits))

    shared = docs.sparkSession.sparkContext.broadcast(
        bit_filter(wanted.select("doc_id").mapInPandas(mark, "chunk int, low binary"), bits, 1))

    def work(batches):
        for pdf in batches:
            pdf = pdf[pdf["doc_id"].notna()]
            ids = pdf["doc_id"].to_numpy().astype(np.int64)
            pdf = pdf[with_bit(shared.value, slots_of(mix64(ids.view(U)), bits))] if len(pdf) else pdf
            out = []
            for d, body in zip(pdf["doc_id"], pdf["body"]):
                s = shingles_of(body, k)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append((int(d), key, s.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "node", "shingles"])

    found = docs.where("doc_id is not null").mapInPandas(work, "doc_id long, node long, shingles binary")
    return cut_lineage(found.join(wanted, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "shingles"))


def _verify_stars(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) whose sets reach the similarity.  b's sets stream past a's,
    a centre with many edges being split into salted parts."""
    # written, so that the join's exchanges serve no aggregation and AQE can split a hot centre
    salts = cut_lineage(edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")))
    salted = edges.join(salts, "a").select("a", "b", F.expr("pmod(xxhash64(b), salts)").cast("int").alias("salt"))
    member = salted.join(sets, salted.b == sets.node).select("a", "salt", F.lit(1).alias("kind"), "b", "shingles")
    centre = (salted.select("a", "salt").distinct().join(sets, F.col("a") == sets.node)
              .select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "shingles"))

    def work(batches):
        at, held = None, None
        for (a, salt), part in runs(batches, ["a", "salt"]):
            out = []
            for kind, b, raw in zip(part["kind"], part["b"], part["shingles"]):
                s = np.frombuffer(raw, U)
                if kind == 0:
                    at, held = (a, salt), s
                elif at == (a, salt) and alike(held, s, num, den):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return (member.unionByName(centre).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
            .mapInPandas(work, "a long, b long"))


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |x and y| >= num * |x or y|, in whole numbers."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _verify_rest(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components within a bucket (key, node, comp)."""
    mixed = (members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.count(F.lit(1)).alias("n"), F.mode("comp", True).alias("main"))
             .where("lo <> hi").select("key", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = members.join(mixed, "key").join(sets, "node").select("key", "main", "blocks", "node", "comp", "shingles")
    target = rows.select("key", F.expr("pmod(xxhash64(node), blocks)").cast("int").alias("block"),
                         F.lit(0).alias("kind"), "node", "comp", "shingles")
    query = rows.where("comp <> main").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("kind"), "node", "comp", "shingles")

    def work(batches):
        at, block, index = None, [], None
        for key, part in runs(batches, ["key", "block"]):
            if key != at:
                at, block, index, root = key, [], None, {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            out = []
            for kind, node, comp, raw in zip(part["kind"], part["node"], part["comp"], part["shingles"]):
                s = np.frombuffer(raw, U)
                if kind == 0:
                    block.append((node, comp, s))
                    continue
                if not block:
                    continue
                if index is None:
                    sizes = np.array([len(x[2]) for x in block])
                    every, owner = np.concatenate([x[2] for x in block]), np.repeat(np.arange(len(block)), sizes)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], sizes
                every, owner, sizes = index
                lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
                n = hi - lo
                places = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                both = np.bincount(owner[places], minlength=len(block))
                for i in np.flatnonzero(den * both >= num * (sizes + len(s) - both)):
                    x, y = find(comp), find(block[i][1])
                    if x != y:
                        root[x] = y
                        out.append((node, block[i][0]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return (target.unionByName(query).repartition("key", "block").sortWithinPartitions("key", "block", "kind", "node")
            .mapInPandas(work, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 25, rows: int = 4,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Classes of documents linked by ``den * |A and B| >= num * |A or B|`` over
    sets of distinct k-word shingles (lower-cased ASCII, white-space words).

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id reachable), kept.  Null or empty texts have empty sets and link with
    nothing; texts under k words are one shingle.  Rows without an id link with
    nothing and have no component (kept false).  Repeated rows share a class.  An
    empty table gives an empty result; other columns are not read.

    With 25 bands of 4 a pair at similarity 0.8 shares no band with probability
    2e-6; with 20 of 5 a pair at 0.85 with 8e-6."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    out = _classes(src, k, num, den, bands, rows)
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 25, rows: int = 4,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash) of the one document that stays of each class of
    :func:`near_duplicates`: smallest id, then smallest xxhash64 of the text, as an
    id may have several texts.  Texts without a word are classes of their own;
    rows without an id are left out."""
    src = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.xxhash64(text).alias("text_hash"))
    lone = F.col("class").isNull()
    return (_classes(src, k, num, den, bands, rows).where(lone | (F.col("doc_id") == F.col("component_id")))
            .groupBy("class", F.when(lone, F.col("doc_id")).alias("d"), F.when(lone, F.col("text_hash")).alias("h"))
            .agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash"))


def _classes(src: DataFrame, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """The rows of src (doc_id, body and whole numbers) without body, with
    n_shingles, class and component_id, both null where the row links with nothing.
    Different classes have the same component_id where an id has several texts."""
    sigs = cut_lineage(_signatures(src, k, bands, rows))
    nodes = cut_lineage(sigs.where("n_shingles > 0 and doc_id is not null").groupBy("node")
                        .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    spread = nodes.select("node", F.explode("bands").alias("key"))
    full = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    members = cut_lineage(spread.join(full, "key").select("key", "a", "node"))
    edges = cut_lineage(members.where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
                        .where("shared > 1").drop("shared"))
    sets = _sets(src, members.select("node").distinct().join(nodes.select("node", "doc_id"), "node"), k)
    links = cut_lineage(_verify_stars(edges, sets, num, den))
    first = cut_lineage(components(links))

    def comp_of(df, comps):
        return (df.join(comps, df.node == comps.id, "left")
                .withColumn("comp", F.coalesce("component_id", "node")).drop("id", "component_id"))

    rest = _verify_rest(comp_of(members.select("key", "node"), first), sets, num, den)
    stars = first.where("id <> component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    final = components(rest.unionByName(stars))
    named = comp_of(nodes.select("node", "doc_id"), final)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "comp").select(F.col("node").alias("n"), F.col("comp").alias("class"), "component_id")
    return sigs.drop("bands").join(
        found, (F.col("node") == F.col("n")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left").drop("node", "n")
