"""Embedding near-dedup: navigable small-world graphs per shard, links by exact cosine.

1. Valid vectors are merged by value (pre-aggregated, by a 128-bit hash): equal
   vectors are one entry with a multiplicity, so copies cost nothing further on.
2. Entries of one length are dealt to shards by hash. Each shard builds its own hierarchical
   graph (:class:`Graph`) in one task and travels from then on as one row: the
   vectors and the neighbour lists of every layer. A shard holds at most about
   ``SHARD`` entries; their number grows with the data, their size does not.
3. Every entry queries every shard of its length: a shard is one partition that
   unpacks its graph once and lets the queries stream past in batches. A search keeps a beam of the
   best entries seen. Beams widen in two ways: a query of which half the beam
   links gets a wider one, up to an exhaustive scan of the shard; and each batch is
   audited against brute force, its beam being doubled until the audit's recall
   passes (at last the scan, which is exact). Audited are a sample of its queries
   and, as these may have no links, entries of the shard turned away by just less
   than a link allows.
4. What a search finds is verified by cosine in double precision. A task counts
   a query's links and keeps one link per component of the shard, so the links
   of a large group never become rows; links between components of shards are
   merged and united by :func:`~gridflow.llm.common.components`.

Defined cases: vectors that are null, zero, or hold null or non-finite
components have no links and are components of their own; rows that repeat a
vec_id are one vector (the smallest valid array); vectors of different lengths
have no links with each other; rows with a null vec_id are left out; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

SHARD = 65_536  # entries a shard holds at most, on average
LEAST_SHARDS, LEAST = 6, 2_048  # so many shards at least, if they then hold so many entries
DEGREE = 12  # neighbours on upper layers; twice that on the lowest
BUILD_BEAM = 48
BEAM = 6  # first beam of a search
AUDIT = 192  # audited queries of a batch, and audited entries of a shard
RECALL = 0.99


def valid(embedding: Column) -> Column:
    """Non-null, not all zero, and all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(embedding.isNotNull() & ~bad & some, F.lit(False))


def merged(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, ok): one row per non-null id; v is the smallest valid array, null if there is none."""
    ok = valid(F.col(vec_col))
    one = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(ok, F.col(vec_col)).alias("v"))
    return one.groupBy("id").agg(F.min("v").alias("v")).withColumn("ok", F.col("v").isNotNull())


class Graph:
    """A hierarchical navigable small world over unit vectors, built and searched in batches.

    Layer l holds the entries whose level is at least l; levels fall off
    geometrically and come from the entries' order, which is a hash order. Each
    layer's entries are linked to at most ``width`` diverse near neighbours.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.x, self.layers, self.members = x, layers, members

    @classmethod
    def build(cls, x: np.ndarray, seed: int) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(DEGREE)).astype(int), 6)
        level[0] = max(level.max(), 1)
        order = np.argsort(-level, kind="stable")
        layers, members = [], []
        for at in range(level[0] + 1):
            own = order[level[order] >= at]
            members.append(own)
            layers.append(_reachable(_layer(x[own], DEGREE * (2 if at == 0 else 1))))
        return cls(x, layers, members)

    def descend(self, q: np.ndarray) -> np.ndarray:
        """An entry point on the lowest layer for each query."""
        entry = None
        for at in range(len(self.layers) - 1, 0, -1):
            own = self.members[at]
            if entry is None:
                start = np.zeros((len(q), 1), np.int64)
            else:
                place = np.full(len(self.x), 0, np.int64)
                place[own] = np.arange(len(own))
                start = place[entry][:, None]
            ids, _ = _beam(self.x[own], self.layers[at], q, start, 4)
            entry = own[ids[:, 0]]
        # the lowest layer holds all entries, in the order of members[0]
        place = np.empty(len(self.x), np.int64)
        place[self.members[0]] = np.arange(len(self.x))
        return place[entry]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam after a best-first search, best first, -1 where it has fewer."""
        own = self.members[0]
        ids, sims = _beam(self.x[own], self.layers[0], q, self.descend(q)[:, None], beam)
        return np.where(ids >= 0, own[ids], -1), sims


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once; each round opens ``step`` entries a query."""
    m, n = len(q), len(x)
    beam = min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    opened = np.ones((m, beam), bool)
    ids[:, : start.shape[1]] = start
    sims[:, : start.shape[1]] = np.einsum("qsd,qd->qs", x[start], q)
    opened[:, : start.shape[1]] = False
    seen = np.zeros((m, n), bool)
    seen[np.arange(m)[:, None], start] = True
    live = np.arange(m)
    step = min(step, beam)
    while len(live):
        rest = np.where(opened[live], -np.inf, sims[live])
        pick = np.argpartition(-rest, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(rest, pick, 1) > -np.inf
        go = good.any(axis=1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        rows = live[:, None]
        opened[rows, pick] = True
        found = near[np.where(good, ids[rows, pick], 0)]
        found = np.where(good[:, :, None], found, -1).reshape(len(live), -1)
        found.sort(axis=1)
        new = found >= 0
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        new &= ~seen[rows, np.maximum(found, 0)]
        seen[np.broadcast_to(rows, found.shape)[new], found[new]] = True
        s = np.full(found.shape, -np.inf, np.float32)
        at = np.nonzero(new)
        s[at] = np.einsum("ed,ed->e", x[found[at]], q[live[at[0]]])
        all_ids = np.concatenate((ids[live], found), axis=1)
        all_sims = np.concatenate((sims[live], s), axis=1)
        all_open = np.concatenate((opened[live], ~new), axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        opened[live] = np.take_along_axis(all_open, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, np.take_along_axis(ids, order, 1), -1), sims


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Up to ``width`` of each row's candidates (best first), preferring ones nearer to the row than to each other."""
    m, c = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    closest = np.full((m, c), -np.inf, np.float32)
    kept = np.zeros((m, c), bool)
    count = np.zeros(m, np.int64)
    for j in range(c):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < width)
        kept[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, :, j]), closest)
    # fill up with the best of the others
    rank = np.where(kept, np.arange(c), np.where(ids >= 0, np.arange(c) + c, 3 * c))
    order = np.argsort(rank, axis=1, kind="stable")[:, :width]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < width:
        out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
    return out


def _layer(x: np.ndarray, width: int) -> np.ndarray:
    """Neighbour lists of one layer; entries are inserted in batches that at most double it."""
    n = len(x)
    near = np.full((n, width), -1, np.int64)
    done = 0
    while done < n:
        size = min(max(done, 64), 512, n - done)
        new = np.arange(done, done + size)
        peers = x[new] @ x[new].T
        np.fill_diagonal(peers, -np.inf)
        c = min(BUILD_BEAM, size - 1) if size > 1 else 0
        ids = np.argsort(-peers, axis=1, kind="stable")[:, :c] + done
        sims = np.take_along_axis(peers, ids - done, 1).astype(np.float32)
        if done:
            entry = np.zeros((size, 1), np.int64)
            old, old_sims = _beam(x[:done], near[:done], x[new], entry, BUILD_BEAM)
            ids, sims = np.concatenate((old, ids), axis=1), np.concatenate((old_sims, sims), axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        if ids.shape[1]:
            near[new] = _diverse(x, ids, sims, width)
            _link_back(x, near, new, width)
        done += size
    return near


def _reachable(near: np.ndarray, spare: int = 4) -> np.ndarray:
    """The lists with room for ``spare`` more, in which entries that no search could come to from the first one get a link from a neighbour of theirs."""
    near = np.pad(near, ((0, 0), (0, spare)), constant_values=-1)
    seen = np.zeros(len(near), bool)
    edge = np.zeros(1, np.int64)
    while True:
        while len(edge):
            seen[edge] = True
            edge = np.unique(near[edge])
            edge = edge[edge >= 0]
            edge = edge[~seen[edge]]
        fixed = []
        for u in np.flatnonzero(~seen):
            for v in near[u][near[u] >= 0]:
                free = np.flatnonzero(near[v] < 0)
                if seen[v] and len(free):
                    near[v, free[0]] = u
                    fixed.append(u)
                    break
        if not fixed:
            return near
        edge = np.array(fixed)


def _link_back(x: np.ndarray, near: np.ndarray, new: np.ndarray, width: int) -> None:
    """The neighbours of ``new`` get links back; full lists are chosen anew."""
    src = np.repeat(new, width)
    dst = near[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    sims = np.einsum("ed,ed->e", x[src], x[dst])
    order = np.lexsort((-sims, dst))
    src, dst = src[order], dst[order]
    first = np.r_[True, dst[1:] != dst[:-1]]
    rank = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
    ok = rank < width
    target, row = np.unique(dst[ok], return_inverse=True)
    add = np.full((len(target), width), -1, np.int64)
    add[row, rank[ok]] = src[ok]
    both = np.concatenate((near[target], add), axis=1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    s = np.where(both >= 0, np.einsum("tcd,td->tc", x[np.maximum(both, 0)], x[target]), -np.inf).astype(np.float32)
    order = np.argsort(-s, axis=1, kind="stable")
    near[target] = _diverse(x, np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1), width)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ed,ed->e", a, b) / np.sqrt(np.einsum("ed,ed->e", a, a) * np.einsum("ed,ed->e", b, b))


def turned(x: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors whose cosine with the rows of ``x`` is just above ``least``, in directions fixed by a seed."""
    away = np.random.default_rng(len(x)).normal(size=x.shape)
    away -= np.einsum("ed,ed->e", away, x)[:, None] * x
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    c = min(1.0, least + (1 - least) / 100)
    out = c * x + math.sqrt(1 - c * c) * np.where(norm > 1e-9, away / np.maximum(norm, 1e-9), 0)
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def known_recall(graph: Graph, least: float, beam: int) -> float:
    """The share of sampled entries that a beam of this width finds from vectors just near enough to be linked.

    Queries of which half the beam links are left out: they get a wider beam anyway.
    """
    sample = np.unique(np.linspace(0, len(graph.x) - 1, min(AUDIT, len(graph.x))).astype(int))
    ids, sims = graph.search(turned(graph.x[sample].astype(np.float64), least), beam)
    due = (sims >= least - 1e-5).sum(axis=1) * 2 < sims.shape[1]
    return float((ids == sample[:, None]).any(axis=1)[due].mean()) if due.any() else 1.0


def linked(graph: Graph, raw: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) pairs with a cosine of at least ``least``; ``raw`` and ``q`` as given, not scaled."""
    n = len(raw)
    uq = _unit(q).astype(np.float32)
    near = least - 1e-5  # single precision may be off by less
    out_q, out_e = [], []

    def scan(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for i in range(0, len(which), 256):
            part = which[i : i + 256]
            hit = np.nonzero(uq[part] @ graph.x.T >= near)
            a.append(part[hit[0]])
            b.append(hit[1])
        return np.concatenate(a) if a else np.empty(0, int), np.concatenate(b) if b else np.empty(0, int)

    def pairs(which: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links found by beams of this width, and the queries of which half the beam links."""
        a, b, full = [], [], []
        for i in range(0, len(which), 512):
            part = which[i : i + 512]
            ids, sims = graph.search(uq[part], beam)
            hit = np.nonzero((sims >= near) & (ids >= 0))
            a.append(part[hit[0]])
            b.append(ids[hit])
            full.append(part[(sims >= near).sum(axis=1) * 2 >= sims.shape[1]])
        return np.concatenate(a), np.concatenate(b), np.concatenate(full)

    todo, beam = np.arange(len(q)), BEAM
    sample = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
    true_q, true_e = scan(np.unique(sample))
    truth = set(zip(true_q.tolist(), true_e.tolist(), strict=True))
    share = 2  # of the shard that a beam may have before a scan takes its place
    while len(todo):
        if beam * share >= n:
            a, b = scan(todo)
            full = np.empty(0, int)
        elif known_recall(graph, least, beam) < RECALL:
            beam *= 2
            continue
        else:
            a, b, full = pairs(todo, beam)
            wide = np.isin(a, full)
            audited = set(sample.tolist()) & set(todo.tolist()) - set(full.tolist())
            due = {p for p in truth if p[0] in audited}
            got = len(due & set(zip(a.tolist(), b.tolist(), strict=True)))
            if got < RECALL * len(due):
                beam *= 2
                continue
            a, b = a[~wide], b[~wide]
        out_q.append(a)
        out_e.append(b)
        # queries with many links: array products over the whole shard soon cost less than wide beams
        todo, beam, share = full, beam * 2, 256
    if not out_q:
        return np.empty(0, int), np.empty(0, int)
    a, b = np.concatenate(out_q), np.concatenate(out_e)
    ok = np.zeros(len(a), bool)
    for i in range(0, len(a), 65_536):
        ok[i : i + 65_536] = _cosines(q[a[i : i + 65_536]], raw[b[i : i + 65_536]]) >= least
    return a[ok], b[ok]


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of links among 0 .. n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not (label == label[label]).all():
            label = label[label]
        if (label == before).all():
            break
    return label


def _build(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """A shard's entries (id, mult, v) as one packed row, and its entries with their own links."""
    pdf = pdf.sort_values("id")
    ids, mult = pdf["id"].to_numpy(np.int64), pdf["mult"].to_numpy(np.int64)
    shard = int(pdf["shard"].iloc[0])
    v = np.stack(pdf["v"].to_numpy())
    graph = Graph.build(_unit(v).astype(np.float32), shard + 1)
    a, b = linked(graph, v, v, least)
    other = a != b
    a, b = a[other], b[other]
    comp = ids[_min_labels(len(ids), a, b)]
    links = np.bincount(a, mult[b], len(ids)).astype(np.int64)
    return pd.DataFrame(
        {
            "shard": [shard],
            "ids": [ids.tobytes()],
            "comp": [comp.tobytes()],
            "mult": [mult.tobytes()],
            "links": [links.tobytes()],
            "vec": [v.tobytes()],
            "kind": [v.dtype.str],
            "dim": [v.shape[1]],
            "near": [[layer.astype(np.int32).tobytes() for layer in graph.layers]],
            "members": [[m.astype(np.int32).tobytes() for m in graph.members]],
        }
    )


_SHARD = "shard int, ids binary, comp binary, mult binary, links binary, vec binary, kind string, dim int, near array<binary>, members array<binary>"


def _vectors(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["vec"], np.dtype(row["kind"])).reshape(-1, row["dim"])


def _graph(row: pd.Series) -> Graph:
    members = [np.frombuffer(m, np.int32).astype(np.int64) for m in row["members"]]
    layers = [np.frombuffer(x, np.int32).astype(np.int64).reshape(len(m), -1) for x, m in zip(row["near"], members, strict=True)]
    return Graph(_unit(_vectors(row)).astype(np.float32), layers, members)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of packed shards: (shard, id, comp, links, v)."""
    for batch in batches:
        for _, row in batch.iterrows():
            ids, comp, links = (np.frombuffer(row[c], np.int64) for c in ("ids", "comp", "links"))
            v = _vectors(row)
            for i in range(0, len(ids), 8192):
                at = slice(i, i + 8192)
                yield pd.DataFrame({"shard": row["shard"], "id": ids[at], "comp": comp[at], "links": links[at], "v": list(v[at])})


def _answers(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """(id, links, -1, -1) of queries with links in a shard, and (-1, -1, comp, to) of components that they join.

    Rows come by shard, each shard's packed row before its queries.
    """
    index = None
    for pdf in batches:
        for _, own in pdf.groupby("shard", sort=False):
            for _, row in own[own["ids"].notna()].iterrows():
                index = (np.frombuffer(row["comp_of"], np.int64), np.frombuffer(row["mult"], np.int64), _vectors(row), _graph(row))
            mine = own[own["ids"].isna()]
            if not len(mine):
                continue
            comp, mult, v, graph = index
            a, b = linked(graph, v, np.stack(mine["v"].to_numpy()), least)
            if not len(a):
                continue
            mine_id, mine_comp = mine["id"].to_numpy(np.int64), mine["comp"].to_numpy(np.int64)
            counts = np.bincount(a, mult[b], len(mine)).astype(np.int64)
            hit = np.flatnonzero(counts)
            edges = np.unique(np.stack((mine_comp[a], comp[b]), axis=1), axis=0)
            none, blank = np.full(len(hit), -1), np.full(len(edges), -1)
            yield pd.DataFrame({"id": np.r_[mine_id[hit], blank], "links": np.r_[counts[hit], blank], "comp": np.r_[none, edges[:, 0]], "to": np.r_[none, edges[:, 1]]})


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of every non-null id; links are cosines of at least ``least``."""
    keyed = merged(vectors, id_col, vec_col).select("id", "v", "ok", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    base = cut(keyed)
    entries = cut(base.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.min_by("v", "id").alias("v")))
    first, shards = {}, 0
    for r in entries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row for each length
        count = max(-(-r["n"] // SHARD), min(LEAST_SHARDS, -(-r["n"] // LEAST)))
        first[r["dim"]] = (shards, shards + count)
        shards += count
    if not shards:
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    bounds = [F.create_map(*[F.lit(x) for dim, pair in first.items() for x in (dim, pair[i])])[F.size("v")] for i in (0, 1)]
    dealt = entries.select("id", "mult", "v", (bounds[0] + F.pmod(F.xxhash64("id"), bounds[1] - bounds[0])).cast("int").alias("shard"))
    packed = cut(dealt.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(lambda pdf: _build(pdf, least), _SHARD))
    own = cut(packed.mapInPandas(_entries, f"shard int, id long, comp long, links long, v {entries.schema['v'].dataType.simpleString()}"))
    others = F.explode(F.filter(F.sequence(bounds[0], bounds[1] - 1), lambda s: s != F.col("shard"))).alias("shard")
    # numbers are never null, so that pandas keeps them as integers
    asked = own.select("id", "comp", "v", F.lit(0).alias("dim"), others)
    held = packed.withColumnRenamed("comp", "comp_of").drop("links").select("*", *[F.lit(0).cast("long").alias(c) for c in ("id", "comp")])
    rows = held.unionByName(asked, allowMissingColumns=True).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("ids").isNull())
    found = cut(rows.mapInPandas(lambda it: _answers(it, least), "id long, links long, comp long, to long"))
    across = found.where("links >= 0").groupBy("id").agg(F.sum("links").alias("more"))
    united = components(found.where("links < 0").select(F.col("comp").alias("a"), F.col("to").alias("b")))
    per_entry = (
        own.select("id", "comp", "links")
        .join(across, "id", "left")
        .join(united, F.col("comp") == F.col("node"), "left")
        .select("id", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "comp").alias("component"))
        .join(entries.select("id", "k1", "k2", "mult"), "id")
        .select("k1", "k2", (F.col("links") + F.col("mult") - 1).alias("links"), "component")
    )
    return (
        base.select("id", "ok", "k1", "k2")
        .join(per_entry.withColumn("ok", F.lit(True)), ["ok", "k1", "k2"], "left")
        .select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
  SELECT DISTINCT vec_id, vec_id AS other FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reach r LEFT JOIN counted c ON r.vec_id = c.a GROUP BY r.vec_id
"""
