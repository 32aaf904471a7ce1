"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put to the leaf of its nearest centres. A query goes
through the tree best bin first: a priority queue holds open nodes by how near their centre is, and leaves come
out in that order. How many leaves are visited is calibrated: on part of the sample the number is widened
until the recall against brute force reaches the wanted one. Neighbouring leaves make up runs of a size, to which a
query is sent once; runs are cut into parts by a hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import small_table, stored
from prefspark.llm.vectors import QUERY_BLOCK, as_blob, hashed_parts, matrix, opened, packed, queries_of, rows_of, usable

SAMPLE_ROWS = 16_384  # rows the tree is fitted on
BRANCHES = 8
LEAF_SAMPLE = 96  # sample rows below which a node is not split
PART_ROWS = 4_096
RUN_ROWS = 4 * PART_ROWS
CALIBRATION = 256  # sample rows used as queries
SENT_BYTES = 4 << 20  # of query vectors that leave a worker at once
SLACK = 1e-9  # above the error of a cosine by matrix product


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row by itself: equal rows have equal cosines. Scaled against overflow."""
    a, b = query / np.abs(query).max(), rows / np.abs(rows).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, starting from distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        filled = np.linalg.norm(sums, axis=1) > 1e-12
        centres = sums[filled] / np.linalg.norm(sums[filled], axis=1, keepdims=True)
    return centres


class KMeansTree:
    """Nodes with the centres of their children; a child is a node number or, negative, a leaf."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.kids: list[list[int]] = []
        self.leaves = 0
        x = _unit(sample) if len(sample) else np.ones((1, 1))
        self._split(x, branches, leaf, rng)

    def _split(self, x: np.ndarray, branches: int, leaf: int, rng: np.random.Generator) -> int:
        centres = _kmeans(x, branches, rng) if len(x) > leaf else x[:1]
        at = np.argmax(x @ centres.T, axis=1)
        node = len(self.kids)
        self.centres.append(centres)
        self.kids.append([])
        for i in range(len(centres)):
            below = x[at == i]
            if len(below) > leaf and len(below) < len(x):
                self.kids[node].append(self._split(below, branches, leaf, rng))
            else:
                self.leaves += 1
                self.kids[node].append(-self.leaves)
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, going down by nearest centres."""
        x = _unit(x)
        out = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            at = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            for i, kid in enumerate(self.kids[node]):
                below = rows[at == i]
                if kid < 0:
                    out[below] = -kid - 1
                elif len(below):
                    stack.append((kid, below))
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        q = _unit(query[None])[0]
        queue, out = [(-1.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                continue
            for near, kid in zip((self.centres[node] @ q).tolist(), self.kids[node]):
                heapq.heappush(queue, (-near, kid))
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Leaves to visit for the wanted recall of the ``k`` nearest within the sample."""
        if len(sample) <= k:
            return self.leaves
        x, leaf = _unit(sample), self.assign(sample)
        queries = np.arange(0, len(x), max(1, len(x) // CALIBRATION))
        near = x[queries] @ x.T
        near[np.arange(len(queries)), queries] = -2
        wanted = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = [self.visits(sample[q], self.leaves) for q in queries]
        place = np.empty((len(queries), self.leaves), np.int64)
        for i, leaves in enumerate(order):
            place[i, leaves] = np.arange(len(leaves))
        needed = np.sort(np.take_along_axis(place, leaf[wanted], axis=1).ravel())
        visited = 1
        while visited < self.leaves and np.searchsorted(needed, visited) < recall * len(needed):
            visited = min(self.leaves, visited + max(1, visited // 8))
        return visited


def sent(ids: np.ndarray, x: np.ndarray, visited: np.ndarray, starts: np.ndarray, most: int = SENT_BYTES) -> Iterator[pa.RecordBatch]:
    """One row per run of leaves with the queries that visit it, and which of its leaves as bits; about ``most`` bytes at a time.

    ``visited`` has a row per query and a column per leaf, and ``starts`` says where each run begins.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        run, *blobs = zip(*rows)
        columns = [pa.array(run, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)]
        return pa.RecordBatch.from_arrays(columns, ["run", "q_ids", "q_data", "q_leaves"])

    out, size = [], 0
    for run, (a, b) in enumerate(zip(starts, [*starts[1:], visited.shape[1]])):
        i = np.flatnonzero(visited[:, a:b].any(axis=1))
        if len(i):
            out.append((run, ids[i].tobytes(), as_blob(x[i]), np.packbits(visited[i, a:b], axis=1).tobytes()))
            size += sum(map(len, out[-1][1:]))
        if size >= most:
            yield batch(out)
            out, size = [], 0
    if out:
        yield batch(out)


def nearest(
    df: DataFrame,
    k: int = 5,
    every: int = 50,
    recall: float = 0.97,
    id_col: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    query_block: int = QUERY_BLOCK,
    leaf_sample: int = LEAF_SAMPLE,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Per query the ``k`` nearest rows found by cosine: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``, candidates all rows of another id; ties go to the
    smaller id. NULL and zero vectors, those with NULL or non-finite components take no part;
    nor do rows without an id. Vectors are compared with those of their length; of rows under one id the least is the
    query. Where the visited leaves hold fewer than ``k`` candidates, more leaves are visited until they do. An empty table gives an empty result; other columns are not read.
    """
    options = k, every, recall, sample_rows, leaf_sample, part_rows, query_block, run_rows
    found = [_of_length(*rows, *options) for rows in usable(df, id_col, vector, zero=False)]
    return reduce(DataFrame.unionByName, found)


def _of_length(
    rows: DataFrame, length: int, k: int, every: int, recall: float, sample_rows: int, leaf_sample: int, part_rows: int, query_block: int,
    run_rows: int,
) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    share = F.lit(sample_rows * (1 << 30) // max(n, 1))
    drawn = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < share  # about sample_rows, equal rows once
    some = rows.where(drawn).distinct().toArrow()  # as Python rows a number takes four times its bytes
    sample = matrix(some["v"], max(length, 1))
    sample = sample[np.lexsort((*sample.T[::-1], some["vec_id"].to_numpy()))]
    tree = KMeansTree(sample, leaf=leaf_sample)
    visited = tree.calibrate(sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)  # centres of at most sample_rows leaves

    def assign(batches):
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("v"), length)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], ["vec_id", "v", "leaf"])

    placed = stored(rows.mapInArrow(assign, "vec_id long, v array<double>, leaf long"), "leaves")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per leaf
    held = np.array([counts.get(i, 0) for i in range(tree.leaves)], np.int64)
    # Neighbouring leaves of about RUN_ROWS rows are a run: a query is sent once to each run that it visits a leaf of.
    in_run = (np.cumsum(held) - held) // run_rows
    starts, in_run = np.unique(in_run, return_index=True, return_inverse=True)[1:]
    rows_in = np.bincount(in_run, held).astype(np.int64)
    runs = small_table(
        spark, [(i, int(r), max(1, -(-int(rows_in[r]) // part_rows))) for i, r in enumerate(in_run)], "leaf long, run long, parts long"
    )
    dealt = placed.join(F.broadcast(runs), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    index = packed(dealt, ["run", "part"], length, ["leaf"])

    asked, _ = hashed_parts(queries_of(rows, every), query_block, "block")
    asked = packed(asked, ["block"], length)

    def spread(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, x = opened(row["ids"], row["data"], length)
                goes = np.zeros((len(ids), tree_leaves), bool)
                for i, q in enumerate(x):
                    leaves = shared.value.visits(q, visited)
                    if held[leaves].sum() <= k:
                        every_leaf = shared.value.visits(q, tree_leaves)
                        enough = int(np.searchsorted(np.cumsum(held[every_leaf]), k + 1)) + 1
                        leaves = every_leaf[: max(enough, visited)]
                    goes[i, leaves] = True
                yield from sent(ids, x, goes & (held > 0), starts)

    tree_leaves = tree.leaves

    def solve(batches):
        for batch in batches:
            for row in rows_of(batch):
                q_ids, q = opened(row["q_ids"], row["q_data"], length)
                ids, x = opened(row["ids"], row["data"], length)
                first = starts[row["run"]]
                bits = np.frombuffer(row["q_leaves"], np.uint8).reshape(len(q), -1)
                goes = np.unpackbits(bits, axis=1).astype(bool)[:, np.frombuffer(row["leaf"], np.int32) - first]
                near = np.where(goes, _unit(q) @ _unit(x).T, -3.0)
                found = []
                for i in range(len(q)):
                    mine = np.where(ids == q_ids[i], -3.0, near[i])
                    at = max(len(mine) - k, 0)
                    keep = np.flatnonzero((mine >= np.partition(mine, at)[at] - SLACK) & (mine > -2))
                    exact = cosines(q[i], x[keep])
                    best = np.lexsort((ids[keep], -exact))[:k]
                    found += [(int(q_ids[i]), int(ids[keep[b]]), float(exact[b])) for b in best]
                query, vec, score = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                    ["query_id", "vec_id", "score"],
                )

    # Spark sizes a function's rows by their columns' types, far too low for these: left to itself it would broadcast them.
    pairs = asked.mapInArrow(spread, "run long, q_ids binary, q_data binary, q_leaves binary").join(index.hint("merge"), "run")
    scored = pairs.mapInArrow(solve, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
