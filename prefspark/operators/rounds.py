"""Batches that end with a round of generation, where what a round brings beyond the batch is lost.

Where a batch ends depends on where the one before did. A batch that starts with so many kept groups behind it ends at the
first round that has ``size`` more, which is one pointer per distinct number of kept groups. The ends that are reached
from the start follow by doubling the pointers: a logarithmic number of joins, no loop over rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.scalars import floor_div
from prefspark.operators.positions import dense_position
from prefspark.session import materialize


def _next_ends(marks: DataFrame, size: int) -> DataFrame:
    """``i, to``: of each number of kept groups the place of the least one that has ``size`` more.

    Numbers are looked up within stretches of ``size``, which hold at most as many.
    """
    own = marks.withColumn("_stretch", floor_div(F.col("kept"), size))
    last = own.groupBy("_stretch").agg(F.max("i").alias("_last"))
    asks = own.join(last, "_stretch").select(
        (F.col("_stretch") + 1).alias("_stretch"), (F.col("kept") + size).alias("_at"), F.lit(0).alias("_is_mark"), "i", "_last"
    )
    points = own.select("_stretch", F.col("kept").alias("_at"), F.lit(1).alias("_is_mark"), "i", F.lit(None).cast("long").alias("_last"))
    lower = Window.partitionBy("_stretch").orderBy("_at", "_is_mark").rowsBetween(Window.unboundedPreceding, -1)
    both = asks.unionByName(points).withColumn("_below", F.coalesce(F.sum("_is_mark").over(lower), F.lit(0)))
    return both.where("_is_mark = 0").select("i", (F.col("_last") + 1 + F.col("_below")).alias("to"))


def full_batches(rounds: DataFrame, size: int) -> DataFrame:
    """``batch, start_kept, end_kept, start_seen, end_seen`` of every batch that gets full.

    ``rounds`` has, per round, ``kept`` and ``seen``: groups kept and samples seen up to its end.
    """
    spark = rounds.sparkSession
    start = spark.range(0, 1, 1, 1).select(F.col("id").alias("kept"), F.col("id").alias("seen"))
    marks = rounds.select(F.col("kept").cast("long"), F.col("seen").cast("long")).unionByName(start)
    marks = marks.groupBy("kept").agg(F.min("seen").alias("seen"))  # a batch ends with the first round of a number
    marks = materialize(dense_position(marks, ["kept"], "i"), "round-marks")
    n, kept = marks.agg(F.count(F.lit(1)), F.max("kept")).first()
    # Every third doubling is stored; those between are joins of a few copies of a stored one.
    jumps = [materialize(_next_ends(marks, size).where(F.col("to") < n), "round-ends")]
    for power in range(1, (kept // size).bit_length()):
        far = jumps[-1].select(F.col("i").alias("to"), F.col("to").alias("_far"))
        doubled = jumps[-1].join(far, "to").select("i", F.col("_far").alias("to"))
        jumps.append(doubled if power % 3 else materialize(doubled, "round-ends"))
    reached = spark.range(0, 1, 1, 1).select(F.col("id").alias("i"), F.col("id").alias("nth"))
    for power, jump in reversed(list(enumerate(jumps))):
        further = reached.join(jump, "i").select(F.col("to").alias("i"), (F.col("nth") + (1 << power)).alias("nth"))
        reached = reached.unionByName(further)
        reached = reached if power % 3 else materialize(reached, "round-chain")
    ends = reached.join(marks, "i").select("nth", "kept", "seen")
    starts = ends.select((F.col("nth") + 1).alias("nth"), F.col("kept").alias("start_kept"), F.col("seen").alias("start_seen"))
    found = ends.withColumnsRenamed({"kept": "end_kept", "seen": "end_seen"}).join(starts, "nth")
    return found.select((F.col("nth") - 1).alias("batch"), "start_kept", "end_kept", "start_seen", "end_seen")
