"""Exact top-k by inner product with block-at-a-time pruning.

Documents are dealt to shards; a shard orders its documents so that alike ones
are neighbours and cuts that order into ranges of ``BLOCK`` documents. A block
keeps its documents' rows (the forward index) and, for each term, the largest
and the smallest value (a negative query weight meets the smallest). For a
query, the sum of the products with those is an upper bound of every score in
the block. Blocks are visited in the order of their bounds and scored through
the forward index until the next bound falls below the k-th score found. A
block whose bound equals that score is still visited, since a smaller id wins a tie.

Each shard is one partition: its documents come first and are indexed once, then
the queries stream past in batches, each query sending k rows on. Terms are the
vectors' dimensions and values are integers, so scores are exact: products are in
double precision where all sums are below 2**53, else in 64-bit integers.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part; vectors of different lengths are not compared; rows that repeat an
id are one vector (the smallest valid array); null ids are left out; queries with
fewer than k candidates return all of them; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD = 16_384  # documents a shard holds, on average
LEAST_SHARDS = 6
BATCH = 4_096  # queries that are looked at together
BLOCK = 64
SCALE = 256
_NONE = -(1 << 62)  # below every score


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, w array<long>): floor(SCALE * component) of every usable vector; of rows that repeat an id, of the smallest array."""
    rows = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    w = F.transform("x", lambda x: F.floor(x.cast("double") * SCALE))
    return rows.groupBy("id").agg(F.min("x").alias("x")).select("id", w.alias("w"))


def _alike(x: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
    """Halves by the term that varies most until ranges have a block's size."""
    stack = [rows]
    while stack:
        rows = stack.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        part = x[rows]
        term = int(part.var(axis=0).argmax())
        order = rows[np.argsort(part[:, term], kind="stable")]
        half = (len(order) // 2 + BLOCK - 1) // BLOCK * BLOCK
        half = half if half < len(order) else len(order) // 2
        stack += [order[half:], order[:half]]


class Shard:
    """Documents in blocks: ids, forward index, and the terms' largest and smallest values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        blocks: list[np.ndarray] = []
        _alike(x, np.argsort(ids, kind="stable"), blocks)
        self.ids, self.x = [ids[b] for b in blocks], [x[b] for b in blocks]
        self.top, self.low = (np.stack([end(b, axis=0) for b in self.x]) for end in (np.max, np.min))
        self.most = np.abs(x.astype(np.float64)).max()

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query row, id, score) of each query's k best, and how many blocks were scored."""
        n = len(q)
        total = np.abs(q.astype(np.float64)).sum(axis=1) * self.most
        exact = bool(total.max() < 2**53)
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        bounds = up @ self.top.T.astype(np.float64) + down @ self.low.T.astype(np.float64)
        if not exact:  # what rounding may have taken from a bound
            bounds += (total * 2.0**-40)[:, None]
        order = np.argsort(-bounds, axis=1, kind="stable")
        best, best_id = np.full((n, k), _NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        live, scored = np.arange(n), 0
        for turn in range(len(self.ids)):
            live = live[bounds[live, order[live, turn]] >= best[live, k - 1].astype(np.float64)]
            if not len(live):
                break
            scored += len(live)
            which = order[live, turn]
            for b in np.unique(which):
                mine = live[which == b]
                s = (q[mine].astype(np.float64) @ self.x[b].T.astype(np.float64)).astype(np.int64) if exact else q[mine] @ self.x[b].T
                cand = np.broadcast_to(self.ids[b], s.shape)
                own = cand == q_ids[mine][:, None]
                s = np.where(own, _NONE, s)
                cand = np.where(own, np.iinfo(np.int64).max, cand)
                all_s, all_id = np.concatenate((best[mine], s), axis=1), np.concatenate((best_id[mine], cand), axis=1)
                pick = np.lexsort((all_id, -all_s), axis=1)[:, :k]
                best[mine] = np.take_along_axis(all_s, pick, 1)
                best_id[mine] = np.take_along_axis(all_id, pick, 1)
        at = np.nonzero(best_id != np.iinfo(np.int64).max)
        return at[0], best_id[at], best[at], scored


def top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best of ``docs`` (id, w) for each of ``queries`` (id, w), but for itself."""
    n = docs.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    held = docs.select("id", "w", shard, F.lit(False).alias("asks"))
    asked = queries.select("id", "w", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
    rows = held.unionAll(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, index = None, [], {}
        for pdf in batches:
            for at, own in pdf.groupby("shard", sort=False):
                if at != shard:
                    shard, parts, index = at, [], {}
                mine = own[own["asks"]]
                if len(mine) < len(own):
                    parts.append(own[~own["asks"]])
                if not len(mine):
                    continue
                if parts:  # the shard's documents are complete
                    index = {size: Shard(i, x) for size, i, x in _by_length(pd.concat(parts))}
                    parts = []
                for size, ids, q in _by_length(mine):
                    if size in index:
                        for i in range(0, len(ids), BATCH):
                            row, found, score, _ = index[size].best(ids[i : i + BATCH], q[i : i + BATCH], k)
                            yield pd.DataFrame({"query_id": ids[i : i + BATCH][row], "id": found, "score": score})

    found = rows.mapInPandas(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows (id, w), by the length of their vectors."""
    sizes = pdf["w"].map(len)
    for size in sizes.unique():
        own = pdf[sizes == size]
        yield size, own["id"].to_numpy(np.int64), np.stack(own["w"].to_numpy())


def op2_block_topk(spark, sf_dir: str) -> DataFrame:
    docs = cut(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    out = top_k(docs, docs.where("id % 50 = 0"), 5)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), w AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM v GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.w, d.w) AS BIGINT) AS score
  FROM w q JOIN w d ON q.vec_id <> d.vec_id AND len(q.w) = len(d.w) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
