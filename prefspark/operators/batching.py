"""Length-balanced batches.

First-fit, differencing and greedy packing are sequential over the samples of one training step, so
a step is the unit of work: steps run in parallel, each as one array of lengths, in n log n. A step is
one global batch of a trainer; there is no bound on its samples.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.scalars import floor_div
from prefspark.operators.groups import join_unique, spread, with_group_stats
from prefspark.operators.positions import dense_position
from prefspark.operators.shaping import pad_batch

def first_fit_count(lengths, capacity: int) -> int:
    """Number of bins when each length goes to the first bin with room; an oversize one opens its own.

    The room of the bins is kept in a tree of maxima, so a bin is found by its depth: n log n in all.
    """
    n = len(lengths)
    if not n:
        return 0
    leaves = 1 << (n - 1).bit_length()
    most = [capacity] * (2 * leaves)  # bins not opened yet are empty
    used = 0
    for length in map(int, lengths):
        if length > capacity:
            node = leaves + used  # no bin has room for it: the next one, overfull
        else:
            node = 1
            while node < leaves:
                node *= 2
                if most[node] < length:
                    node += 1
        used = max(used, node - leaves + 1)
        most[node] -= length
        node >>= 1
        while node:
            left, right = most[2 * node], most[2 * node + 1]
            best = left if left >= right else right
            if most[node] == best:
                break
            most[node] = best
            node >>= 1
    return used


class _Split:
    """A partial split: its non-empty parts (total, size, first sample, merge tree), of ``k`` in all.

    Parts leave at the light end only, so a heap of the lightest is exact and one of the heaviest skips
    those that have left.
    """

    __slots__ = ("k", "light", "heavy", "left")

    def __init__(self, parts: list[tuple], k: int):
        self.k, self.light, self.left = k, list(parts), set()
        self.heavy = [(-p[0], -p[1], -p[2]) for p in parts]
        heapq.heapify(self.light)
        heapq.heapify(self.heavy)

    def add(self, part: tuple) -> None:
        heapq.heappush(self.light, part)
        heapq.heappush(self.heavy, (-part[0], -part[1], -part[2]))

    def take(self, n: int) -> list[tuple]:
        """Remove the ``n`` lightest parts, lightest first."""
        out = [heapq.heappop(self.light) for _ in range(n)]
        self.left.update((-p[0], -p[1], -p[2]) for p in out)
        return out

    def entry(self) -> tuple:
        """Heap entry: widest spread first, then by the heaviest part, largest first."""
        while self.heavy[0] in self.left:
            self.left.remove(heapq.heappop(self.heavy))
        heaviest = self.heavy[0]
        least = self.light[0][0] if len(self.light) == self.k else 0
        return least + heaviest[0], heaviest, self

    def joined(self, other: _Split) -> _Split:
        """The heaviest part of each with the lightest of the other; work by the side with fewer parts."""
        n = max(len(self.light) + len(other.light) - self.k, 0)
        pairs = zip(reversed(self.take(n)), other.take(n))
        new = [(x[0] + y[0], x[1] + y[1], x[2], (x[3], y[3])) for x, y in pairs]
        large, small = (self, other) if len(self.light) >= len(other.light) else (other, self)
        for part in [*new, *small.light]:
            large.add(part)
        return large


def differencing_split(lengths, k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest-differencing split of the indices into ``k`` non-empty parts of similar total.

    Partial splits wait in a heap; the two of the widest spread are joined. Parts are merge trees, whose
    members are listed once at the end. Ties go by (total, size, first sample), largest first.
    """
    n = len(lengths)
    if n < k:
        raise ValueError(f"cannot split {n} samples into {k} parts")
    if equal_size and n % k:
        raise ValueError(f"{n} samples do not divide into {k} equal parts")
    values = [int(x) for x in lengths]
    order = sorted(range(n), key=lambda i: (values[i], i))
    groups = [order[s : s + k] for s in range(0, n, k)] if equal_size else [[i] for i in order]
    heap = [_Split([(values[i], 1, i, i) for i in group], k).entry() for group in groups]
    heapq.heapify(heap)
    while len(heap) > 1:
        widest = heapq.heappop(heap)[2]
        heapq.heapreplace(heap, widest.joined(heap[0][2]).entry())
    parts = [sorted(_members(part[3])) for part in sorted(heap[0][2].light, key=lambda p: p[:3], reverse=True)]
    if len(parts) < k:
        raise ValueError("a part is empty")
    return parts


def _members(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += node
        else:
            out.append(node)
    return out


def greedy_split(lengths, k: int, equal_size: bool = False) -> list[list[int]]:
    """Each sample, in input order, to the lightest part so far; of equal sizes if asked for."""
    n = len(lengths)
    if equal_size and n % k:
        raise ValueError(f"{n} samples do not divide into {k} equal parts")
    parts: list[list[int]] = [[] for _ in range(k)]
    heap = [(0, 0, j) for j in range(k)]  # (samples if their number counts, total, part)
    for i, length in enumerate(lengths):
        count, total, j = heap[0]
        parts[j].append(i)
        heapq.heapreplace(heap, (count + equal_size, total + int(length), j))
    return parts


def _part_ids(parts: list[list[int]], n: int) -> np.ndarray:
    ids = np.empty(n, dtype="int32")
    for j, members in enumerate(parts):
        ids[members] = j
    return ids


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype("int32")


def _split_udf(split: Callable) -> Callable[[Column, Column], Column]:
    """Column function (lengths of a step, number of parts) to the part of every sample.

    Steps arrive many to an Arrow batch, so the per-call overhead is shared among them.
    """

    @F.arrow_udf("array<int>")
    def run(lengths: pa.Array, k: pa.Array) -> pa.Array:
        flat, offsets = _lists(lengths)
        out = np.empty(len(flat), dtype="int32")
        for (start, end), parts in zip(pairwise(offsets), k.to_pylist()):
            out[start:end] = _part_ids(split(flat[start:end], parts), end - start)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))

    return run


def _fit_count(lengths: Column, capacity: int) -> Column:
    """Number of first-fit bins of a step."""

    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        flat, offsets = _lists(column)
        return pa.array([first_fit_count(flat[s:e], capacity) for s, e in pairwise(offsets)], type=pa.int32())

    return run(lengths)


def _sum_by_part(values: Column, parts: Column) -> Column:
    """For every sample the total of ``values`` over the samples of its part."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, parts: pa.Array) -> pa.Array:
        (flat, offsets), (ids, _) = _lists(values), _lists(parts)
        out = np.empty(len(flat))
        for s, e in pairwise(offsets):
            out[s:e] = np.bincount(ids[s:e], weights=flat[s:e])[ids[s:e]]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))

    return run(values, parts)


def _pack(df: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """One row per step with ``_rows``, its (order, length) pairs in order, and ``_lengths``."""
    narrow = spread(df.select(*keys, order, length), keys)
    rows = F.sort_array(F.collect_list(F.struct(order, length)))
    packed = narrow.groupBy(*keys).agg(rows.alias("_rows"))
    return packed.withColumn("_lengths", F.col(f"_rows.{length}").cast("array<bigint>"))


def _unpack(packed: DataFrame, keys: list[str], order: str, length: str, fields: list[str]) -> DataFrame:
    """Back to one row per sample with the per-sample arrays ``fields``."""
    zipped = F.arrays_zip(F.col("_rows").alias("_r"), *[F.col(f) for f in fields])
    long = packed.select(*keys, F.explode(zipped).alias("_z"))
    return long.select(
        *keys,
        F.col(f"_z._r.{order}").alias(order),
        F.col(f"_z._r.{length}").alias(length),
        *[F.col(f"_z.{f}").alias(f) for f in fields],
    )


def first_fit_batches(
    df: DataFrame, max_tokens: int, step: str = "step", order: str = "position", length: str = "total_length",
    ring: int = 1, tensor: int = 1, extra_keys: list[str] = (),
) -> DataFrame:
    """Bins of first-fit packing per step, in arrival order."""
    keys = [step, *extra_keys]
    packed = _pack(df, keys, order, length)
    return packed.select(*keys, _fit_count(F.col("_lengths"), max_tokens * ring * tensor).alias("num_batches"))


def _partitions(df: DataFrame, k: int, split: Callable, step: str, order: str, length: str) -> DataFrame:
    packed = _pack(df, [step], order, length).withColumn("part", _split_udf(split)(F.col("_lengths"), F.lit(k)))
    return _unpack(packed, [step], order, length, ["part"])


def balanced_partitions(
    df: DataFrame, k: int, equal_size: bool = False, step: str = "step", order: str = "position",
    length: str = "total_length",
) -> DataFrame:
    """Part of every sample in a k-way largest-differencing split of its step."""
    return _partitions(df, k, lambda x, n: differencing_split(x, n, equal_size), step, order, length)


def greedy_partitions(
    df: DataFrame, k: int, equal_size: bool = False, step: str = "step", order: str = "position",
    length: str = "total_length",
) -> DataFrame:
    """Part of every sample when each goes to the lightest part of its step."""
    return _partitions(df, k, lambda x, n: greedy_split(x, n, equal_size), step, order, length)


def snake_balance(
    df: DataFrame, workers: int, length: str = "total_length", id_col: str = "position", drop_ragged: bool = True
) -> DataFrame:
    """Deal the samples, longest first, to workers in alternating direction.

    Chunks of one sample per worker are taken from the long and the short end in turn, the short
    half mirrored. A short last chunk drops the workers it does not reach unless ``drop_ragged`` is
    off. Pure arithmetic on the sorted position.
    """
    ranked = dense_position(df, [F.col(length).desc(), F.col(id_col)], "_i")
    n = ranked.count()
    chunks = -(-n // workers)
    half = chunks // 2
    tail = n - (chunks - 1) * workers
    chunk = floor_div(F.col("_i"), workers)
    slot = F.pmod(F.col("_i"), F.lit(workers))
    size = F.when(chunk == chunks - 1, F.lit(tail)).otherwise(F.lit(workers))
    seat = F.when(chunk < half, slot).otherwise(size - 1 - slot)
    from_end = F.lit(chunks - 1) - chunk
    turn = F.when(chunk < half, 2 * chunk).when(from_end < half, 2 * from_end + 1).otherwise(F.lit(2 * half))
    out = ranked.select(*df.columns, seat.cast("int").alias("worker"), turn.cast("long").alias("turn"))
    return out.where(F.col("worker") < tail) if drop_ragged else out


def dynamic_micro_batches(
    df: DataFrame, max_tokens: int, rank: str = "rank", step: str = "step", order: str = "position",
    length: str = "total_length", ring: int = 1, tensor: int = 1,
) -> DataFrame:
    """Micro-batch of every sample of a (rank, step), with loss scale and optimizer-step flag.

    All ranks of a step use the largest first-fit count among them.
    """
    keys = [rank, step]
    packed = _pack(df, keys, order, length)
    counts = packed.select(step, _fit_count(F.col("_lengths"), max_tokens * ring * tensor).alias("_count"))
    packed = join_unique(packed, counts.groupBy(step).agg(F.max("_count").alias("_parts")), [step])
    packed = packed.withColumn("micro_batch", _split_udf(differencing_split)(F.col("_lengths"), F.col("_parts")))
    ones = F.transform("_lengths", lambda _: F.lit(1).cast("bigint"))
    size = _sum_by_part(ones, F.col("micro_batch"))
    packed = packed.withColumn("_size", size).withColumns(
        {
            "loss_scale": F.transform("_size", lambda x: x / F.size("_lengths")),
            "optimizer_step": F.transform("micro_batch", lambda p: (p == F.col("_parts") - 1).cast("int")),
        }
    )
    return _unpack(packed, keys, order, length, ["micro_batch", "loss_scale", "optimizer_step"])


def rollout_micro_batches(
    df: DataFrame, workers: int, max_tokens: int | None = None, size: int | None = None, step: str = "step",
    order: str = "position", length: str = "total_length", ring: int = 1, tensor: int = 1,
) -> DataFrame:
    """Chunks of ``size`` rows, or token-budgeted batches per step.

    The first-fit count is floored to a multiple of the workers (at least one each), so a batch can
    exceed the budget; ``tokens`` reports its total.
    """
    if size is not None:
        return df.withColumn("micro_batch", floor_div(F.col(order), size))
    packed = _pack(df, [step], order, length)
    fits = F.floor(_fit_count(F.col("_lengths"), max_tokens * ring * tensor) / workers) * workers
    packed = packed.withColumn("_parts", F.greatest(fits, F.lit(workers)).cast("int"))
    packed = packed.withColumn("micro_batch", _split_udf(differencing_split)(F.col("_lengths"), F.col("_parts")))
    totals = F.transform(_sum_by_part(F.col("_lengths"), F.col("micro_batch")), lambda x: x.cast("long"))
    return _unpack(packed.withColumn("tokens", totals), [step], order, length, ["micro_batch", "tokens"])


def seqlen_balance_report(
    df: DataFrame, k: int, step: str = "step", order: str = "position", length: str = "total_length", part: str = "part"
) -> DataFrame:
    """Load of consecutive chunks against the balanced parts, per step.

    ``order`` must be dense. Chunks hold n // k samples each; a remainder forms one more chunk.
    """
    sized = with_group_stats(df, [step], {"_n": F.count(F.lit(1)), "_start": F.min(order)})
    chunk = floor_div(F.col(order) - F.col("_start"), floor_div(F.col("_n"), k))
    sized = sized.withColumn("_chunk", chunk)

    def spread(key: str, low: str, high: str) -> DataFrame:
        sums = sized.groupBy(step, key).agg(F.sum(length).alias("_s"))
        return sums.groupBy(step).agg(
            F.min("_s").alias(low), F.max("_s").alias(high), F.sum("_s").alias(f"_total_{key}")
        )

    naive = spread("_chunk", "min", "max")
    balanced = spread(part, "balanced_min", "balanced_max")
    return naive.join(balanced, step).select(
        step,
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("minmax_diff"),
        "balanced_min",
        "balanced_max",
        (F.col("_total__chunk") / k).alias("mean"),
    )


def concat_samples(
    df: DataFrame, arrays: dict[str, int], size: int, others: list[str] = (), position: str = "position"
) -> DataFrame:
    """Batches of ``size`` consecutive samples: padded arrays and aligned lists of the other fields.

    A batch is bounded by ``size`` rows, so collecting it is as well.
    """
    batched = df.withColumn("batch", floor_div(F.col(position), size))
    padded = pad_batch(batched, arrays, "batch")
    fields = [position, *arrays, *others]
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    packed = padded.groupBy("batch").agg(rows.alias("_rows"))
    return packed.select("batch", *[F.col(f"_rows.{f}").alias(f) for f in fields])


def split_batches(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per sample of a batch; columns of unequal length fail the row."""
    sizes = [F.size(f) for f in fields]
    checked = df
    for f, size in zip(fields[1:], sizes[1:]):
        bad = F.raise_error(F.concat(F.lit(f"column {f} has "), size, F.lit(" samples, expected "), sizes[0]))
        checked = checked.withColumn(f, F.when(size != sizes[0], bad.cast(df.schema[f].dataType)).otherwise(F.col(f)))
    long = checked.select("batch", F.posexplode(F.arrays_zip(*fields)).alias("row_in_batch", "_s"))
    return long.select("batch", "row_in_batch", *[F.col(f"_s.{f}").alias(f) for f in fields])
