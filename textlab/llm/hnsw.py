"""Embedding near-duplicates by one hierarchical navigable small-world graph per
shard (Malkov and Yashunin 2018), queried by every vector.

Graphs are built and searched with numpy, many vectors at a time.  Each shard
audits its own recall: members moved to the link threshold must find what a
full scan of the shard finds, else the beam is doubled, up to the whole shard.
A query whose whole beam passes the threshold searches again with a wider one, so
that a group of any size is found whole.  Hits are verified by cosine in double
precision.  A task returns the number of links of each query and, for
connectivity, one edge per node to its group, never the pairs of a group."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from textlab.llm.common import BATCH_ROWS, components, cut_lineage, runs
from textlab.llm.rolling import mix64

LINKS = 16          # per node on the upper layers, twice as many on the lowest
BEAM_BUILD = 48
BEAM = 32
SHARDS = 4          # at least
CAPACITY = 100_000  # vectors of one shard
BLOCK = 25_000      # queries of one task
AUDIT = 128
RECALL = 0.999
CELLS = 6_000_000   # queries x nodes of one search, and links that are looked at at once
PIECE = 1 << 22     # bytes of a row of a graph: whole ones would be copied many times over
VERIFIED = 1 << 16  # links whose cosine is taken at once


def unit(v: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components do not overflow
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class HNSW:
    """Layers of (nodes, links): nodes are row numbers, links padded with -1."""

    def __init__(self, vectors: np.ndarray, seed: np.ndarray):
        self.v = vectors.astype(np.float32)
        n = len(self.v)
        u = (mix64(seed.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2 ** 53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(np.int64), 8)
        self.links = [np.full((n, 2 * LINKS if l == 0 else LINKS), -1, np.int32) for l in range(int(self.level.max(initial=0)) + 1)]
        self.members: list[np.ndarray] = [np.zeros(0, np.int64) for _ in self.links]
        self.beam = BEAM
        order = np.lexsort((np.arange(n), -self.level))
        at = 0
        while at < n:
            level = self.level[order[at]]
            size = min(max(32, at // 4), 512)
            batch = order[at:at + size]
            batch = batch[self.level[batch] == level]
            self._insert(batch, int(level))
            at += len(batch)

    def _insert(self, new: np.ndarray, level: int) -> None:
        q = self.v[new]
        start = None
        for l in range(len(self.links) - 1, -1, -1):
            have = self.members[l]
            width = BEAM_BUILD if l <= level else 2
            if len(have) <= 4 * BEAM_BUILD:
                s = q @ self.v[have].T if len(have) else np.zeros((len(new), 0), np.float32)
                top = np.argsort(-s, axis=1, kind="stable")[:, :width]
                ids, sims = have[top], np.take_along_axis(s, top, 1)
            else:
                ids, sims = self.search_layer(q, l, start, width)
            if len(have):
                start = ids[:, :4]
            if l <= level:
                inside = q @ q.T
                np.fill_diagonal(inside, -2)
                k = min(BEAM_BUILD, len(new) - 1)
                near = np.argsort(-inside, axis=1, kind="stable")[:, :k]
                ids = np.concatenate([ids, new[near]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(inside, near, 1)], axis=1)
                self._connect(l, new, ids, sims)
                self.members[l] = np.concatenate([have, new])

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row's node
        than to any chosen one; free places go to the nearest of the others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, c = ids.shape
        out = np.full((rows, most), -1, np.int32)
        for a in range(0, rows, 256):
            i, s = ids[a:a + 256], sims[a:a + 256]
            vec = self.v[np.maximum(i, 0)]
            gram = vec @ vec.transpose(0, 2, 1)
            ok = (i >= 0) & (s > -1.5)
            chosen = np.zeros(i.shape, bool)
            worst = np.full(i.shape, -2, np.float32)  # nearest chosen one of each candidate
            for j in range(c):
                take = ok[:, j] & (worst[:, j] < s[:, j])
                chosen[:, j] = take
                worst = np.where(take[:, None], np.maximum(worst, gram[:, j]), worst)
            # the chosen first, then the rest, each nearest first
            rank = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :most]
            got = np.take_along_axis(np.where(ok, i, -1), rank, 1)
            out[a:a + 256, :got.shape[1]] = got
        return out

    def _connect(self, l: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[l]
        most = links.shape[1]
        mine = self._choose(ids, sims, LINKS)
        links[new, :LINKS] = mine
        # links back: to each named node its namers, by node
        src, dst = np.repeat(new, LINKS), mine.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, n = np.unique(dst, return_index=True, return_counts=True)
        n = np.minimum(n, most)  # the rest of very many namers keep their own links
        cand = np.full((len(nodes), most + int(n.max(initial=0))), -1, np.int64)
        cand[:, :most] = links[nodes]
        col = np.arange(cand.shape[1] - most)
        take = col[None, :] < n[:, None]
        rows, cols = np.nonzero(take)
        cand[rows, most + cols] = src[first[rows] + cols]
        cand[:, most:][(cand[:, most:, None] == cand[:, None, :most]).any(2)] = -1
        full = (cand >= 0).sum(1) > most
        simple = np.sort(-cand[~full], axis=1)[:, :most]  # those with an id first
        links[nodes[~full]] = np.where(-simple >= 0, -simple, -1)
        if full.any():
            c = cand[full]
            s = np.einsum("rd,rcd->rc", self.v[nodes[full]], self.v[np.maximum(c, 0)])
            s[c < 0] = -2
            links[nodes[full]] = self._choose(c, s, most)

    def search_layer(self, q: np.ndarray, l: int, start: np.ndarray, beam: int):
        """(ids, sims) of each query's beam on a layer, nearest first, padded with -1 and -2."""
        step = max(1, min(512, CELLS // max(1, len(self.v))))
        parts = [self._search(q[a:a + step], l, start[a:a + step], beam) for a in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q, l, start, beam):
        links, b = self.links[l], len(q)
        expand = 4 if beam >= 16 else 1
        claim = np.full((b, len(self.v)), -1, np.int16)
        ids, sims = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32)
        done = np.zeros((b, beam), bool)
        rows_live, fresh = np.arange(b), start
        while len(rows_live):
            # new nodes of each row, once each
            r = rows_live[:, None]
            known = np.where(fresh >= 0, claim[r, np.maximum(fresh, 0)], 0) >= 0
            place = np.broadcast_to(np.arange(fresh.shape[1], dtype=np.int16), fresh.shape)
            rr, cc = np.nonzero(~known)
            claim[rows_live[rr], fresh[rr, cc]] = place[rr, cc]
            mine = claim[rows_live[rr], fresh[rr, cc]] == place[rr, cc]
            rr, cc = rr[mine], cc[mine]
            s = np.full(fresh.shape, -2, np.float32)
            s[rr, cc] = np.einsum("kd,kd->k", q[rows_live[rr]], self.v[fresh[rr, cc]])
            alls = np.concatenate([sims[rows_live], s], axis=1)
            alli = np.concatenate([ids[rows_live], np.where(s > -1.5, fresh, -1)], axis=1)
            alld = np.concatenate([done[rows_live], np.zeros(s.shape, bool)], axis=1)
            top = np.argpartition(-alls, beam - 1, axis=1)[:, :beam] if alls.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(alls), beam))
            order = np.take_along_axis(alls, top, 1).argsort(axis=1, kind="stable")[:, ::-1]
            top = np.take_along_axis(top, order, 1)
            ids[rows_live], sims[rows_live] = np.take_along_axis(alli, top, 1), np.take_along_axis(alls, top, 1)
            d = np.take_along_axis(alld, top, 1) | (ids[rows_live] < 0)
            # the nearest that have not been expanded
            nxt = np.argsort(d, axis=1, kind="stable")[:, :expand]
            open_ = ~np.take_along_axis(d, nxt, 1)
            np.put_along_axis(d, nxt, True, axis=1)
            done[rows_live] = d
            go = open_.any(1)
            nodes = np.where(open_, np.take_along_axis(ids[rows_live], nxt, 1), -1)[go]
            rows_live = rows_live[go]
            fresh = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(nodes), nodes.shape[1] * links.shape[1]).astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, beam: int):
        start = np.broadcast_to(self.members[-1][:8], (len(q), min(8, len(self.members[-1]))))
        for l in range(len(self.links) - 1, 0, -1):
            start = self.search_layer(q, l, start, 8)[0][:, :4]
        return self.search_layer(q, 0, start, beam)

    def linked_parts(self, q: np.ndarray, at_least: float):
        """(query row, node) of all nodes found at the similarity or above, about CELLS at most at once."""
        todo, beam = np.arange(len(q)), self.beam
        while len(todo):
            whole = beam >= len(self.v) // 2  # as wide as the shard: all of it
            step, wider = max(1, CELLS // max(1, len(self.v) if whole else beam)), []
            for at in range(0, len(todo), step):
                part = todo[at:at + step]
                if whole:
                    r, c = np.nonzero(q[part] @ self.v.T >= at_least)
                    yield part[r], c
                    continue
                ids, sims = self.search(q[part], beam)
                # a beam that holds nothing farther may have left some out
                full = sims[:, -1] >= at_least
                r, c = np.nonzero((sims >= at_least) & ~full[:, None])
                yield part[r], ids[r, c]
                wider.append(part[full])
            todo, beam = np.concatenate(wider) if wider else todo[:0], beam * 4

    def linked(self, q: np.ndarray, at_least: float):
        """All of :meth:`linked_parts`."""
        out = list(self.linked_parts(q, at_least))
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, int),) * 2

    def audit(self, at_least: float) -> float:
        """Widen the beam until members moved to the threshold find what a full scan finds."""
        n = len(self.v)
        pick = np.linspace(0, n - 1, min(AUDIT, n)).astype(int)
        rng = np.random.default_rng(1)
        noise = rng.normal(size=(len(pick), self.v.shape[1]))
        own = self.v[pick].astype(np.float64)
        noise -= (noise * own).sum(1, keepdims=True) * own
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        cos = at_least + 1e-4
        q = (cos * own + np.sqrt(max(0.0, 1 - cos * cos)) * noise).astype(np.float32)
        truth = set(zip(*np.nonzero(q @ self.v.T >= at_least)))
        while True:
            found = truth & set(zip(*self.linked(q, at_least)))
            recall = len(found) / max(1, len(truth))
            if recall >= RECALL or self.beam >= n // 2:
                return recall
            self.beam *= 2

    def dump(self, **more: np.ndarray) -> bytes:
        """The graph and ``more`` arrays; without its vectors if ``raw`` is one, from which :func:`units` makes them."""
        out = io.BytesIO()
        np.savez(out, **more, **({} if "raw" in more else {"v": self.v}), level=self.level, beam=self.beam, top=self.members[-1][:8],
                 l0=self.links[0], **{f"l{i}": x[self.level >= i] for i, x in enumerate(self.links) if i},
                 **{f"n{i}": np.flatnonzero(self.level >= i) for i in range(1, len(self.links))})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes | list[bytes]) -> HNSW:
        """A graph from :meth:`dump`; ``own`` has its vectors as doubles if it was dumped with ``raw``, ``more`` the other arrays."""
        z, out = np.load(io.BytesIO(raw if isinstance(raw, bytes) else b"".join(raw))), cls.__new__(cls)
        out.own = units(z["raw"]) if "raw" in z else None
        out.v, out.level, out.beam = z["v"] if out.own is None else out.own.astype(np.float32), z["level"], int(z["beam"])
        out.links = [z["l0"]]
        for i in range(1, int(out.level.max(initial=0)) + 1):
            x = np.full((len(out.v), LINKS), -1, np.int32)
            x[z[f"n{i}"]] = z[f"l{i}"]
            out.links.append(x)
        out.members = [None] * (len(out.links) - 1) + [z["top"]]
        out.more = {c: z[c] for c in ("nodes", "w") if c in z}
        return out


def units(v: np.ndarray, kind=np.float64) -> np.ndarray:
    """:func:`unit`, some rows at once."""
    out = np.empty(v.shape, kind)
    for at in range(0, len(v), BATCH_ROWS):
        out[at:at + BATCH_ROWS] = unit(v[at:at + BATCH_ROWS])
    return out


def _build(at_least: float, kind: str = "float32"):
    def work(batches):
        at, held = None, []

        def done():
            nodes, w, raw = (np.concatenate(x) for x in zip(*held))
            held.clear()
            g = HNSW(units(raw, np.float32), nodes)
            recall = g.audit(at_least)
            data = g.dump(nodes=nodes, w=w, raw=raw)
            for i, start in enumerate(range(0, len(data), PIECE)):
                yield pd.DataFrame({"shard": [at[0]], "piece": [i], "data": [data[start:start + PIECE]], "beam": [g.beam], "recall": [recall]})

        for key, part in runs(batches, ["shard"]):
            if key != at and held:
                yield from done()
            at = key
            held.append((part["node"].to_numpy(), part["w"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(kind)))
        if held:
            yield from done()
    return work


def _query(at_least: float):
    def work(batches):
        at, g, pieces, root = None, None, [], {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def edges():
            e = [(1, x, find(x)) for x in list(root) if find(x) != x]
            return pd.DataFrame(e, columns=["kind", "a", "b"])

        for key, part in runs(batches, ["shard", "block"]):
            if key != at:
                if root:
                    yield edges()
                at, g, pieces, root = key, None, [], {}
            graph = part["kind"].to_numpy() == 0
            pieces += part["data"][graph].tolist()
            part = part[~graph]
            if not len(part) or (g is None and not pieces):
                continue
            if g is None:
                g, pieces = HNSW.load(pieces), []
            nodes, w = g.more["nodes"], g.more["w"]
            q, name = unit(np.stack(part["embedding"].to_numpy())), part["node"].to_numpy()
            n = np.zeros(len(q), np.int64)
            for rows, cols in g.linked_parts(q.astype(np.float32), at_least - 1e-4):
                for i in range(0, len(rows), VERIFIED):
                    r, c = rows[i:i + VERIFIED], cols[i:i + VERIFIED]
                    ok = (np.einsum("kd,kd->k", q[r], g.own[c]) >= at_least) & (name[r] != nodes[c])
                    r, c = r[ok], c[ok]
                    np.add.at(n, r, w[c])
                    for x, y in zip(name[r].tolist(), nodes[c].tolist()):
                        x, y = find(x), find(y)
                        if x != y:
                            root[max(x, y)] = min(x, y)
            yield pd.DataFrame({"kind": 0, "a": name[n > 0], "b": n[n > 0]})
        if root:
            yield edges()
    return work


def graphs(vectors: DataFrame, at_least: float, shards: int, kind: str = "float32") -> DataFrame:
    """One graph per shard of (node, embedding, w) in rows of PIECE bytes: shard, piece, data, beam, recall."""
    return cut_lineage(vectors.repartitionById(shards, F.expr(f"cast(pmod(shard, {shards}L) as int)")).sortWithinPartitions("shard", "node")
                       .mapInPandas(_build(at_least, kind), "shard long, piece long, data binary, beam int, recall double"))


def near_duplicates(rows: DataFrame, at_least: float = 0.95, vec: str = "embedding", vec_id: str = "vec_id",
                    capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Links between vectors at a cosine of ``at_least`` and their components.

    Returns one row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable), kept (vec_id = component_id).
    Equal vectors are one node with a weight.  Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without an id, link with
    nothing (without an id component_id is null and kept false).  Vectors of
    different lengths are not compared.  Components wider than float are compared
    as doubles: only the graph holds floats, of vectors already of length one; the
    smallest and largest doubles count as any other.  A repeated row is another vector.  An
    empty table gives an empty result; other columns are not read."""
    v = F.col(vec)
    kept = "float" if rows.schema[vec].dataType.elementType == FloatType() else "double"  # wider ones are not narrowed
    kind = "float32" if kept == "float" else "float64"
    fine = (F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(vec, lambda x: x != 0))
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast(f"array<{kept}>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    nodes = (src.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
             .withColumn("node", F.xxhash64("embedding")))
    nodes = cut_lineage(nodes)
    n = nodes.count()
    shards, blocks = max(SHARDS, -(-n // capacity)), max(1, -(-n // block))
    base = F.size("embedding").cast("long") * shards
    placed = nodes.withColumn("shard", base + F.expr(f"pmod(node, {shards}L)"))
    index = graphs(placed.select("shard", "node", "embedding", "w"), at_least, shards, kind)
    none = F.lit(None)
    left = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"),
                        F.col("piece").alias("node"), none.cast(f"array<{kept}>").alias("embedding"), "data")
    right = nodes.select(F.explode(F.sequence(base, base + (shards - 1))).alias("shard"),
                         F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)").alias("block"), F.lit(1).alias("kind"),
                         "node", "embedding", none.cast("binary").alias("data"))
    task = F.expr(f"cast(pmod(shard, {shards}L) * {blocks} + block as int)")  # every shard and block is a task of its own
    found = cut_lineage(left.unionByName(right).repartitionById(shards * blocks, task)
                        .sortWithinPartitions("shard", "block", "kind", "node")
                        .mapInPandas(_query(at_least), "kind int, a long, b long"))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    comps = components(found.where("kind = 1").select("a", "b")).select(F.col("id").alias("node"), F.col("component_id").alias("comp"))
    named = (nodes.join(counts, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = named.join(least, "comp").select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), "component_id")
    out = src.join(known, src.fine & (src.embedding == known.e), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
