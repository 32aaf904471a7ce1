"""Exact top-k inner products with a KD-tree per shard.

Rows are dealt to shards by a hash of their id. A shard's tree splits at the median of the widest axis and
keeps each node's tight bounding box. A query goes down the tree best first, by the largest inner product that
a node's box allows; it ends when no open box reaches the k-th best score. That score starts from the query's
search of one shard, done first, and is handed to the search of all others.
"""

from __future__ import annotations

import heapq
import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import stored
from prefspark.llm.vectors import QUERY_BLOCK, hashed_parts, opened, packed, queries_of, rows_of, usable

SHARD_ROWS = 16_384
LEAF_ROWS = 128
EXACT = 1 << 53  # integers below it are exact as doubles


def quantized(x: np.ndarray, factor: int) -> np.ndarray:
    """``floor(factor * x)``: doubles while all inner products stay exact, else Python integers."""
    q = np.floor(factor * x)
    if x.size and np.abs(q).max() ** 2 * x.shape[1] >= EXACT:
        return np.array([[int(c) for c in row] for row in q], object).reshape(x.shape)
    return q


class KdTree:
    """Median splits over ``points``; nodes in order of their making, children after their parent."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        low, high, spans, kids = [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(spans)
            rows = points[self.order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            spans.append((a, b))
            kids.append([])
            if parent >= 0:
                kids[parent].append(node)
            width = high[-1] - low[-1]
            if b - a > leaf and width.max() > 0:
                axis = int(np.argmax(width))
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], middle, axis=0)]
                stack += [(a, a + middle, node), (a + middle, b, node)]
        self.ids, self.points = ids[self.order], points[self.order]
        self.low, self.high, self.spans, self.kids = np.array(low), np.array(high), spans, kids

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with a point of each box."""
        zero = np.zeros_like(queries)
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, least) -> list[tuple[int, int]]:
        """The k best (score, -id) of this shard that reach ``least``; ``own`` is left out."""
        best: list[tuple[int, int]] = []
        queue = [(-bound[0], 0)]
        while queue:
            negative, node = heapq.heappop(queue)
            reach = best[0][0] if len(best) == k else least
            if least is not None and (reach is None or reach < least):
                reach = least
            if reach is not None and -negative < reach:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-bound[kid], kid))
                continue
            a, b = self.spans[node]
            scores = self.points[a:b] @ query
            keep = np.flatnonzero(scores >= reach) if reach is not None else np.arange(b - a)
            if len(keep) > k:  # the k best of this leaf, ties to smaller ids
                keep = keep[np.lexsort((self.ids[a:b][keep], -scores[keep]))]
                keep = keep[: k + int(np.sum(self.ids[a:b][keep] == own))]
            for i in keep.tolist():
                if self.ids[a + i] == own:
                    continue
                item = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=array.dtype == object)
    return out.getvalue()


def top_inner_products(
    df: DataFrame,
    k: int = 5,
    every: int = 50,
    factor: int = 256,
    id_col: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Per query its ``k`` highest integer inner products: ``query_id, rank, vec_id, score``.

    Components become ``floor(factor * x)``. Queries are the rows whose id is divisible by ``every``, candidates
    all rows of another id; ties go to the smaller id. NULL vectors, those with NULL or non-finite components,
    or of no components take no part; nor do rows without an id. Vectors are compared with those of their length. Rows
    repeated under one id count as often as they occur among candidates, and the least of them is the query. Scores beyond 64 bits raise
    an error. An empty table gives an empty result; other columns are not read.
    """
    found = [_of_length(*rows, k, every, factor, shard_rows, query_block) for rows in usable(df, id_col, vector, zero=True)]
    return reduce(DataFrame.unionByName, found)


def _of_length(
    rows: DataFrame, length: int, k: int, every: int, factor: int, shard_rows: int, query_block: int
) -> DataFrame:
    shards, count = hashed_parts(rows, shard_rows, "shard")
    shards = packed(shards, ["shard"], length)
    asked, _ = hashed_parts(queries_of(rows, every), query_block, "block")
    asked = stored(packed(asked, ["block"], length), "query-blocks")
    schema = "block long, query_id long, vec_id long, score long"

    def solve(batches):
        tree, at = None, None
        for batch in batches:
            for row in rows_of(batch):
                if row["shard"] != at:
                    ids, x = opened(row["s_ids"], row["s_data"], length)
                    tree, at = KdTree(ids, quantized(x, factor)), row["shard"]
                ids, x = opened(row["ids"], row["data"], length)
                queries = quantized(x, factor)
                if queries.dtype != tree.points.dtype or (
                    queries.dtype != object and np.abs(queries).max() * np.abs(tree.points).max() * length >= EXACT
                ):
                    queries = np.array([[int(c) for c in q] for q in queries], object)
                least = dict(zip(row["known"] or [], row["least"] or []))
                bounds = tree.bounds(queries)
                found = [
                    (row["block"], int(q), -i, s)
                    for q, x, bound in zip(ids, queries, bounds)
                    for s, i in tree.search(x, q, bound, k, least.get(int(q)))
                ]
                columns = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["block", "query_id", "vec_id", "score"]
                )

    # Spark sizes an explode and a function's rows far too low: left to itself it would broadcast the queries of all shards.
    def searched(pairs: DataFrame) -> DataFrame:
        held = shards.select("shard", F.col("ids").alias("s_ids"), F.col("data").alias("s_data"))
        return pairs.join(held.hint("merge"), "shard").mapInArrow(solve, schema)

    # First one shard for each block of queries, then all, from the k-th score of the first.
    home = asked.withColumns({"shard": F.pmod("block", F.lit(count)), "known": F.lit(None).cast("array<long>"),
                              "least": F.lit(None).cast("array<long>")})
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = searched(home).withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k)
    limits = first.groupBy("block").agg(F.collect_list(F.struct("query_id", "score")).alias("l"))  # of one block
    limits = limits.select("block", F.col("l.query_id").alias("known"), F.col("l.score").alias("least"))
    pairs = asked.join(limits.hint("merge"), "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")))
    best = searched(pairs).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
