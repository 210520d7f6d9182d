"""Exact top-k search by inner product with KD-trees.

Candidates are dealt over shards of at most ``shard_rows``. A shard builds a KD-tree: each node splits at the median of its
widest dimension and keeps the tight box around its points. For a query q and a box the inner product is at most the sum
over dimensions of max(q * low, q * high). Nodes are visited best bound first; a query ends when the best bound left is
below its kth score.

Queries go from shard to shard in rounds, each beginning at a shard of its own: first to one shard, then to three more,
then to twelve, and so on. After a round a query's best k so far are merged, and its kth score goes along to the next
round's shards, which return only what can better it. In a round a shard's candidates come to one task, which builds the
tree, and the queries stream past it, ``block_rows`` at once; candidates aren't copied, and a task holds one shard and one
batch of queries.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, only, read

K, SCALE = 10, 1024
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 32_768, 1024, 256
#: Components in a shard, at most, and rows for which a shard of its own is worth while.
SHARD_SIZE, LEAST_ROWS = 1 << 23, 4096
_LOW = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by way of doubles where these are exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class KdTree:
    """Nodes in the order they are made; a node has its box, its points and, unless it's a leaf, two children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        low, high, first, last, kids = [], [], [], [], []

        def node(a: int, b: int) -> int:
            part = points[order[a:b]]
            low.append(part.min(0))
            high.append(part.max(0))
            first.append(a)
            last.append(b)
            kids.append(None)
            return len(kids) - 1

        todo = [node(0, len(ids))] if len(ids) else []
        while todo:
            n = todo.pop()
            a, b = first[n], last[n]
            spread = high[n].astype(np.float64) - low[n]
            if b - a <= leaf_rows or not spread.any():
                continue
            d, mid = int(spread.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(points[order[a:b], d], mid)]
            kids[n] = (node(a, a + mid), node(a + mid, b))
            todo += kids[n]
        self.ids, self.points, self.kids = ids[order], points[order], kids
        self.first, self.last = first, last
        self.low, self.high = (np.array(x).reshape(len(kids), -1) for x in (low, high))

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query up to k (score, -id), best first, of scores not below its bound and ids other than its own."""
        if not self.kids:
            return [[] for _ in own]
        best = product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)
        out = []
        for i in range(len(own)):
            found: list[tuple[int, int]] = []  # a heap of the k best; its first is the kth
            kth, limits, queue = int(bound[i]), best[i].tolist(), [(-int(best[i, 0]), 0)]
            while queue and -queue[0][0] >= kth:
                n = heapq.heappop(queue)[1]
                if self.kids[n]:
                    for m in self.kids[n]:
                        if limits[m] >= kth:
                            heapq.heappush(queue, (-limits[m], m))
                    continue
                a, b = self.first[n], self.last[n]
                while a < b:  # a leaf of equal points may be long
                    c = min(b, a + 4096)
                    score = product(queries[i : i + 1], self.points[a:c])[0]
                    for j in np.flatnonzero(score >= kth):
                        item = (int(score[j]), -int(self.ids[a + j]))
                        if -item[1] == own[i]:
                            continue
                        if len(found) < k:
                            heapq.heappush(found, item)
                        elif item > found[0]:
                            heapq.heapreplace(found, item)
                        if len(found) == k:
                            kth = max(kth, found[0][0])
                    a = c
            out.append(sorted(found, reverse=True))
        return out


def _matrix(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: row numbers, ids, vectors."""
    ids, lists = rows.column("id").to_numpy(), rows.column("v").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = at, ids[at], flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
    return out


def _search(k: int, block_rows: int):
    """Rows by (shard, asks): a shard's candidates, then its queries with their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        waiting: list[pa.RecordBatch] = []
        trees: dict[int, KdTree] = {}
        for batch in batches:
            shard, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1 if len(shard) else []
            for a, b in itertools.pairwise([0, *change, len(shard)] if len(shard) else []):
                if shard[a] != at:
                    at, waiting, trees = shard[a], [], {}
                if not asks[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    trees = {d: KdTree(ids, x) for d, (_, ids, x) in _matrix(pa.Table.from_batches(waiting)).items()}
                    waiting = []
                for c in range(a, b, block_rows):
                    yield from _answers(trees, pa.Table.from_batches([batch.slice(c, min(b - c, block_rows))]), k)

    return run


def _answers(trees: dict[int, KdTree], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    bound, ranked = queries.column("bound").to_numpy(), []
    for d, (at, own, v) in _matrix(queries).items():
        if d in trees:
            for q, found in zip(own.tolist(), trees[d].search(v, own, bound[at], k), strict=True):
                ranked += [(q, -i, s) for s, i in found]
    if ranked:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*ranked, strict=True)], names=["query_id", "vec_id", "score"])


def floored(vector: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of all components; null for a vector that is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all rows but its own.

    ``is_query`` is a condition on the column vec_id. Equal scores go to the smaller vec_id. Vectors that are null or hold
    a null or non-finite component take no part, nor do rows without id; vectors are compared with those of their own
    length. Fewer than k candidates give all of them, an empty table none. Rows that repeat an id are candidates each,
    but a query is searched once, with its first vector in order. Components are 64-bit integers after flooring, and
    sums beyond 64 bits wrap around. Other columns play no part.
    """
    rows = only(vectors, vec_id=id_col, vector=vector_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), floored("vector", scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows, _ = materialise(rows.where("v IS NOT NULL AND id IS NOT NULL"), "vectors")
    spark = rows.sparkSession
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    most = max(1, min(shard_rows, SHARD_SIZE // max(1, n.d or 1)))
    shards = max(1, -(-n.n // most), min(spark.sparkContext.defaultParallelism, n.n // LEAST_ROWS))
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards).cast("long"))
    candidates = rows.select(hashed("id", "v").alias("shard"), F.lit(False).alias("asks"), "id", "v", F.lit(0).cast("long").alias("bound"))
    queries, _ = materialise(rows.where("asks").groupBy("id").agg(F.min("v").alias("v")), "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, seen = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), 0
    while seen < shards:
        after = min(shards, max(1, 4 * seen))
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        asked = queries.join(kth, "id", "left").withColumn("hop", F.explode(F.sequence(F.lit(seen).cast("long"), F.lit(after - 1).cast("long"))))
        asked = asked.select(F.pmod(hashed("id") + F.col("hop"), F.lit(shards).cast("long")).alias("shard"), F.lit(True).alias("asks"), "id", "v", F.coalesce("bound", F.lit(_LOW)).alias("bound"))
        placed = candidates.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")
        found = placed.mapInArrow(_search(k, block_rows), "query_id long, vec_id long, score long").unionByName(best.drop("rank"))
        best, _ = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        seen = after
    return best


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
