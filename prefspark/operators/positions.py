"""Global row positions and ordered running sums that stay distributed.

Both range-partition the rows, write them once to the shared folder and add per-partition offsets,
so no partition ever holds more than a range of the order, even when one group owns most rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions.scalars import bind, drawn, floor_div
from prefspark.session import materialize

_ROW_BITS = 33  # low bits of monotonically_increasing_id


def _cols(names) -> list[Column]:
    names = [names] if isinstance(names, (str, Column)) else names
    return [n if isinstance(n, Column) else F.col(n) for n in names]


def _ranges(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_position(df: DataFrame, order, name: str = "position", parts: int | None = None) -> DataFrame:
    """Add the 0-based index under ``order``, which must be a total order."""
    cols = _cols(order)
    numbered = df.repartitionByRange(_ranges(df, parts), *cols).sortWithinPartitions(*cols)
    numbered = numbered.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.select(
        *df.columns,
        F.shiftright("_id", _ROW_BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    stored = materialize(numbered, "position")
    # One row per range partition: the window below sorts a few thousand counts.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return stored.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_row")).cast("long").alias(name)
    )


def running_sums(
    df: DataFrame, order, sums: dict[str, Column], groups: list[str] = (), parts: int | None = None
) -> DataFrame:
    """Add inclusive running sums along ``order`` (total within ``groups``), restarting per group.

    A group larger than one range partition is summed piecewise; pieces are then shifted by the
    totals of the pieces before them.
    """
    groups = list(groups)
    cols = _cols(order)
    placed = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    placed = placed.repartitionByRange(_ranges(df, parts), *_cols(groups), *cols)
    stored = materialize(placed.withColumn("_part", F.spark_partition_id()), "running")
    # Structs compare NULL fields as equal, so rows without a group form one.
    keyed = stored.withColumn("_g", F.struct(*groups)) if groups else stored
    of_group = ["_g"] if groups else []

    inside = Window.partitionBy("_part", *of_group).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    totals = keyed.groupBy("_part", *of_group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*of_group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_part", *of_group, *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in sums]
    )
    local = keyed.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(inside) for k in sums})
    out = local.join(shifts, ["_part", *of_group])
    return out.select(*df.columns, *[(F.col(f"_r_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums])


# Shares of the rows tried as tail, from about a ninth less than all to a ten-thousandth.
_FINE = [1 - 10 ** (-j / 16) for j in range(1, 65)]
_TAILS = [1 - 10 ** (-j / 4) for j in range(1, 17)]
_ACCURACY = 10_000  # of the quantile sketch
ONE_TASK = 1 << 17  # rows that one task may sort


def prune_to_tail(df: DataFrame, key: Column, k: int) -> tuple[DataFrame, int, object]:
    """Rows that can be among the ``k`` greatest ``key`` values, a bound of their number, and the least key (None: any).

    One narrow pass makes a quantile sketch, whose error is bounded; of its cuts the highest is taken that at least ``k`` rows
    reach for sure. It is repeated on what is left while that makes it much less, so a tiny share takes a pass or two more.
    The result never depends on the approximation. Missing keys rank last: rows with one stay only if nothing is cut.
    """
    least = None
    while True:
        n, rows, cuts = df.agg(F.count(key), F.count(F.lit(1)), F.percentile_approx(key, _FINE, _ACCURACY)).first()
        error = n / _ACCURACY + 1
        sure = [i for i, share in enumerate(_FINE) if cuts and n * (1 - share) - error >= k]
        if not sure:
            return df, rows, least
        cut = cuts[sure[-1]]
        # As many rows at most reach the cut as reach the next lower one; values that tie with it are known by that.
        below = max((share for share, value in zip(_FINE, cuts) if value < cut), default=0.0)
        bound = min(math.ceil(n * (1 - below) + error), n)
        if least == cut:
            return df, bound, least
        df, least = df.where(key >= cut), cut
        if bound <= max(2 * k, ONE_TASK) or bound > rows / 2:
            return df, bound, least


def _reached() -> list[Column]:
    return [F.count_if(F.col("_key") >= F.col("_b")[j]).alias(f"_n{j}") for j in range(len(_TAILS))]


def _highest_cut(k: int) -> Column:
    return F.greatest(*[F.when(F.col(f"_n{j}") >= k, F.col("_b")[j]) for j in range(len(_TAILS))])


def _numeric(df: DataFrame, ties: list) -> bool:
    return bool(ties) and isinstance(ties[0], str) and isinstance(df.schema[ties[0]].dataType, T.IntegralType)


def _first_of(df: DataFrame, key: Column, ties: list, k: int) -> DataFrame:
    """The rows of :func:`top_k`, in any order."""
    near, bound, least = prune_to_tail(df, key, k)
    order = [key.desc_nulls_last(), *_cols(ties)]
    if least is None and bound <= k:
        return near
    if bound <= ONE_TASK:
        return near.orderBy(*order).limit(k)
    if least is not None and bound > 2 * k and _numeric(df, ties):
        # Most of what is left ties at the cut: all above it belong, and of the ties those that come first.
        above, missing = near.agg(F.count_if(key > least), F.count_if(F.col(ties[0]).isNull())).first()
        if above < k and not missing:
            tied = _first_of(near.where(key == least), -F.col(ties[0]).cast("decimal(38,0)"), ties[1:], k - above)
            return near.where(key > least).unionByName(tied)
    placed = dense_position(near, order, "_position")
    return placed.where(F.col("_position") < k).drop("_position")


def top_k(df: DataFrame, key: Column, ties: list, k: int) -> DataFrame:
    """The ``k`` rows of the greatest ``key``, ties by the columns ``ties``, missing keys last; in that order.

    :func:`prune_to_tail` leaves little more than ``k`` rows, with ties at the cut. So many fit in one task up to a fixed
    number, then Spark's own sort and limit takes the first; beyond it they are numbered by ranges of the order. Rows are
    looked at when the function is called.

    The key is made by a generator: a filter on a computed column is pushed down, where the whole expression stands for every
    mention of the column, and nested conditions then outgrow what the JVM compiles. Filters on a generated column stay above.
    """
    keyed, found = df.withColumn("_rank_key", F.explode(F.array(key))), F.col("_rank_key")
    return _first_of(keyed, found, ties, k).orderBy(found.desc_nulls_last(), *_cols(ties)).drop("_rank_key")


def top_k_per(df: DataFrame, keys: list[str], key: Column, ties: list, k: int) -> DataFrame:
    """:func:`top_k` within every group of ``keys``, of which there are few: each has a cut of its own."""
    bounds = df.groupBy(*keys).agg(F.percentile_approx(key, _TAILS, 10000).alias("_b"))
    counted = df.select(*keys, key.alias("_key")).join(bounds, keys).groupBy(*keys).agg(F.first("_b").alias("_b"), *_reached())
    near = df.join(counted.select(*keys, _highest_cut(k).alias("_cut")), keys)
    near = near.where(F.col("_cut").isNull() | (key >= F.col("_cut"))).drop("_cut")
    placed = dense_position(near, [*keys, key.desc_nulls_last(), *_cols(ties)], "_position")
    starts = placed.groupBy(*keys).agg(F.min("_position").alias("_start"))
    first = placed.join(starts, keys).where(F.col("_position") - F.col("_start") < k)
    return first.select(*df.columns, "_position").orderBy("_position").drop("_position")


def head_limit(df: DataFrame, n: int, key: Column, ties: list) -> DataFrame:
    """First ``n`` rows in source order: greatest numeric ``key`` first, then ``ties``."""
    return top_k(df, key, ties, n)


def iteration_slice(df: DataFrame, iteration: int, batch: int, position: str = "position") -> DataFrame:
    """Rows of one generation round, by dense position."""
    return df.where((F.col(position) >= iteration * batch) & (F.col(position) < (iteration + 1) * batch))


def holdout_head(df: DataFrame, cap: int, fraction: float = 0.01, position: str = "position") -> DataFrame:
    """First ``min(cap, int(N * fraction))`` rows; they stay in the training table as well."""
    total = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n")).scalar()
    return df.where(F.col(position) < F.least(total, F.lit(cap)))


def shard_round_robin(df: DataFrame, n: int, position: str = "position", name: str = "shard") -> DataFrame:
    """Row i goes to shard i mod n."""
    return df.withColumn(name, F.pmod(F.col(position), F.lit(n)))


def fixed_batches(df: DataFrame, size: int, position: str = "position", name: str = "batch") -> DataFrame:
    """Consecutive chunks of ``size`` rows."""
    return df.withColumn(name, floor_div(F.col(position), size))


def epoch_order(df: DataFrame, id_col: str, seed: int, epoch: int) -> DataFrame:
    """Dense index of a shuffle that is a function of (seed + epoch, id)."""
    key = drawn(seed + epoch, id_col)
    return dense_position(df.withColumn("_key", key), ["_key", id_col], "epoch_index").drop("_key")


_MODULUS = 2_147_483_647  # a prime below 2^31, so that products stay within a long
_ROUNDS = ((48_271, 11), (69_621, 101), (39_373, 1_009), (630_360_016, 10_007))  # multipliers, and what sets the rounds apart
_WALK = 64


def _grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid with ``n`` cells or more."""
    a = max(math.isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _mixed(x: Column, seed: int, number: int) -> Column:
    factor, apart = _ROUNDS[number]
    first = F.pmod((x + F.lit(seed % _MODULUS + apart)) * F.lit(factor), F.lit(_MODULUS))
    return F.pmod((first + F.lit(apart)) * F.lit(factor), F.lit(_MODULUS))


def _of(fn, *more):
    """A function of one column, as lambdas of columns may have no other parameters."""
    return lambda c: fn(c, *more)


def permuted(index: Column, n: int, seed: int, back: bool = False) -> Column:
    """A place in [0, n) for each index in [0, n), no two the same; ``back`` gives the index of a place.

    A Feistel network on a grid of a little more than ``n`` cells: either coordinate is shifted by a mix of the other. A cell
    outside goes through again until it is inside, which few do, and hardly any more than once.
    """
    a, b = _grid(n)
    seed = seed % _MODULUS
    start = F.struct(F.pmod(index.cast("long"), F.lit(a)).alias("x"), floor_div(index.cast("long"), a).alias("y"))

    def turned(cell: Column, number: int) -> Column:
        side, other, size = ("x", "y", a) if number % 2 == 0 else ("y", "x", b)
        by = _mixed(cell[other], seed, number)
        moved = F.pmod(cell[side] - by if back else cell[side] + by, F.lit(size))
        return F.struct(*[(moved if s == side else cell[s]).alias(s) for s in "xy"])

    def once(cell: Column) -> Column:
        for number in range(3, -1, -1) if back else range(4):
            cell = bind(cell, _of(turned, number))
        return cell

    def place(cell: Column) -> Column:
        return cell["y"] * F.lit(a) + cell["x"]

    def walk(cell: Column) -> Column:
        steps = F.sequence(F.lit(1), F.when(place(cell) < n, F.lit(1)).otherwise(F.lit(_WALK)))
        last = F.aggregate(steps, cell, lambda c, _: F.when(place(c) < n, c).otherwise(once(c)))
        lost = F.raise_error(F.lit("an index stays outside of the permutation")).cast("long")
        return bind(last, lambda c: F.when(place(c) < n, place(c)).otherwise(lost))

    return bind(once(start), walk) if n else F.lit(None).cast("long")


def permuted_sql(index: str, n: str, seed: int) -> str:
    """One pass of :func:`permuted` as SQL over integers; ``n`` is an expression. What falls outside has to go through again."""
    a = f"(CAST(floor(sqrt({n} - 1)) AS BIGINT) + 1)"
    cell = {"x": f"({index} % {a})", "y": f"({index} // {a})"}
    sizes = {"x": a, "y": f"CAST(ceil({n} / {a}::DOUBLE) AS BIGINT)"}
    for number, (factor, apart) in enumerate(_ROUNDS):
        side, other = ("x", "y") if number % 2 == 0 else ("y", "x")
        first = f"(({cell[other]} + {seed % _MODULUS + apart}) * {factor} % {_MODULUS})"
        cell[side] = f"(({cell[side]} + ({first} + {apart}) * {factor} % {_MODULUS}) % {sizes[side]})"
    return f"({cell['y']} * {a} + {cell['x']})"


def epoch_places(df: DataFrame, n: int, seed: int, epoch: int, position: str = "position", name: str = "epoch_index") -> DataFrame:
    """The index of every row in an epoch's shuffle, from its dense ``position`` among ``n`` rows.

    A function of the row alone: once rows are numbered, no epoch has to sort or move them, and ``permuted(..., back=True)``
    says which row has a place. See :func:`epoch_shards` for ranks and slots.
    """
    return df.withColumn(name, permuted(F.col(position), n, seed * 1_000_003 + epoch))


def epoch_shards(
    df: DataFrame, ranks: int, drop_last: bool = False, consumed: int = 0, index: str = "epoch_index"
) -> DataFrame:
    """Rank and slot of every row of an epoch.

    Rank r takes rows r, r + ranks, …; the table is padded by repeating its head, or its tail is cut.
    Slots below ``consumed // ranks`` are skipped.
    """
    n = df.count()
    per_rank = -(-(n - ranks) // ranks) if drop_last and n % ranks else -(-n // ranks)
    total = per_rank * ranks
    # A row recurs at index, index + n, … below the padded size: at most once more unless n < ranks.
    copies = F.sequence(F.col(index), F.greatest(F.lit(total - 1), F.col(index)), F.lit(max(n, 1)).cast("long"))
    slots = df.withColumn("slot", F.explode(copies)).where(F.col("slot") < total)
    return slots.select(
        *df.columns,
        F.pmod("slot", F.lit(ranks)).alias("rank"),
        floor_div(F.col("slot"), ranks).alias("step"),
    ).where(F.col("step") >= consumed // ranks)
