"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import stored
from prefspark.operators.groups import join_unique


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with ``m``, the least of ``u`` and its neighbours. A hot ``u`` is split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_unique(edges, least, ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    linked = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` with ``v`` the least vertex of ``u``'s component, for every vertex but the least ones.

    ``edges`` has ``u`` and ``v`` of one comparable type; loops and repeated edges do no harm. Every round is
    stored, which cuts the lineage; about log(size of the largest component) rounds.
    """
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.lit(1))
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        found = tuple(now.agg(*mark).first())
        if found == before:
            return now
        before = found
        now = stored(_small_star(_large_star(now)), "edges")
