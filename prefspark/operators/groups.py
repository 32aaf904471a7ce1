"""Statistics of a group on each of its rows, without gathering the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Join per-group aggregates back to the rows.

    A window would put a whole group in one task. Here the aggregate is combined before its shuffle
    and its few rows are joined back; see :func:`join_unique`.
    """
    return join_unique(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to an aggregate that has one row per key; NULL keys are a group like any other.

    AQE broadcasts a small right side by its measured size, and splits the partition of a hot key of
    the left side. It only splits when both inputs come straight from a shuffle, and an aggregate on
    the join keys does not: the hash of the keys as one more key makes Spark shuffle it (once more,
    one row per group).
    """
    hashed = F.xxhash64(*keys)
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumn("_rh", hashed).withColumnsRenamed(names)
    matches = F.col("_h") == F.col("_rh")
    for k, r in names.items():
        matches &= F.col(k).eqNullSafe(F.col(r))
    return left.withColumn("_h", hashed).join(right, matches, how).drop("_h", "_rh", *names.values())


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for Python work per group.

    With an explicit number AQE does not merge partitions that are small in bytes but not in work;
    a following ``groupBy`` on the same keys adds no shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
