"""Exact top-k by inner product of integer vectors, with a KD-tree for each shard of the table.

Vectors are dealt into shards by a hash of their id. A task that holds a shard builds its tree (median splits on
the widest dimension, tight boxes) and answers queries best-first: nodes come in the order of the highest score
that any point of their box could reach, and the search ends where that falls below the k-th score so far. Each
query first meets one shard only; the k-th score found there is propagated as a bound to all other shards, which
return only what reaches it. Shards meet blocks of queries as separate groups, so no task holds all of either,
and nothing is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import columns_of, materialize

K, SCALE = 20, 64
#: Rows of a shard, queries of a block (both on average), and points of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 4096, 4096, 128


class KDTree:
    """Median splits of ``points``; node i has children 2i+1 and 2i+2 while it holds more than LEAF_ROWS."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(points))
        self.low, self.high, self.range = {}, {}, {}
        todo = [(0, 0, len(points))]
        while todo:
            node, a, b = todo.pop()
            own = points[order[a:b]]
            self.low[node], self.high[node], self.range[node] = own.min(axis=0), own.max(axis=0), (a, b)
            if b - a > LEAF_ROWS:
                middle = (b - a) // 2
                widest = int(np.argmax(self.high[node] - self.low[node]))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
                todo += [(2 * node + 1, a, a + middle), (2 * node + 2, a + middle, b)]
        self.points, self.ids = points[order], ids[order]

    def bound(self, node: int, query: np.ndarray) -> float:
        """The highest score that a point of the node's box could have."""
        return np.maximum(query * self.low[node], query * self.high[node]).sum()

    def top(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """(score, id) of the k best but ``own``, best first, ties to smaller ids; only scores of ``least`` or more."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id): its root goes first
        nodes = [(-self.bound(0, query), 0)]
        while nodes:
            reach, node = heapq.heappop(nodes)
            if -reach < least:
                break
            a, b = self.range[node]
            if 2 * node + 1 in self.range:
                for child in (2 * node + 1, 2 * node + 2):
                    if (reach := self.bound(child, query)) >= least:
                        heapq.heappush(nodes, (-reach, child))
                continue
            scores = self.points[a:b] @ query
            for i in np.nonzero(scores >= least)[0]:
                entry = (int(scores[i]), -int(self.ids[a + i]))
                if -entry[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    least = max(least, best[0][0])
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False)))


def _search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of up to k points for each (shard, query); groups are (shard, block)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).astype(np.float64).reshape(n, -1)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            points, asked = (matrix(t.column("v"), t.num_rows) for t in (left, right))
            if np.abs(points).max() * np.abs(asked).max() * points.shape[1] >= 2.0**53:  # doubles would round the scores
                points, asked = (np.array(t.column("v").to_pylist(), object) for t in (left, right))
            tree = KDTree(points, left.column("vec_id").to_numpy())
            for query, id_, least in zip(asked, right.column("query_id").to_pylist(), right.column("least").to_pylist(), strict=True):
                rows += [(id_, found, int(score)) for score, found in tree.top(query, id_, k, float("-inf") if least is None else least)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], schema=schema)

    keys = ["width", "shard", "block"]
    left, right = (df.toDF(*df.columns).groupBy(*keys) for df in (points, queries))  # renamed: both come from one table
    return left.cogroup(right).applyInArrow(answer, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``, against all other rows.

    Components become floor(scale * x). Rows with a null id or a vector that is null, empty or holds null or
    non-finite components take no part; vectors are compared with ones of their own width. A query's own id is no
    candidate of its, also where rows repeat an id; repeated candidate rows each count. Fewer candidates than k
    give all of them; an empty table an empty result. Scores are integers of any size that a long holds.
    """
    whole = (
        columns_of(vectors, "vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") > 0))
        .select("vec_id", F.size("embedding").alias("width"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v"))
    )
    whole = materialize(whole, "vectors")
    ask = F.col("vec_id") % every == 0
    rows, asked = whole.agg(F.count("*"), F.count_if(ask)).first()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asked // block_queries))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    block = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(blocks))
    points = whole.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = whole.where(ask).select(F.col("vec_id").alias("query_id"), "width", "v", block.alias("block"), F.pmod(F.xxhash64(F.col("vec_id"), F.lit(2)), F.lit(shards)).alias("home"))

    first = materialize(_search(points, queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("long")), k), "first")
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = queries.join(bound, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("shard <> home")
    found = first.unionByName(_search(points, others.drop("home"), k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
