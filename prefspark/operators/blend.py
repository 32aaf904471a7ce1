"""Blending, stacking and regrouping of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.scalars import drawn, floor_div
from prefspark.operators.groups import with_group_stats
from prefspark.operators.positions import dense_position
from prefspark.session import materialize

_CHUNK = 1 << 16


def blend_concat(datasets: list[DataFrame]) -> DataFrame:
    """Concatenate in listed order; ``source_ordinal`` keeps the order."""
    tagged = [d.withColumn("source_ordinal", F.lit(i)) for i, d in enumerate(datasets)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def _draws(spark, probs: list[float], seed: int, total: int) -> DataFrame:
    """``draw``, ``source``: which source each of ``total`` draws takes, a function of the seed."""
    uniform = drawn(seed, "draw") / F.lit(float(1 << 60))
    edges = [sum(probs[: i + 1]) / sum(probs) for i in range(len(probs))]
    source = F.lit(len(probs) - 1)
    for i in reversed(range(len(probs) - 1)):
        source = F.when(F.col("_u") < edges[i], F.lit(i)).otherwise(source)
    return spark.range(total).withColumnRenamed("id", "draw").withColumn("_u", uniform).select(
        "draw", source.alias("source_ordinal")
    )


def _occurrences(draws: DataFrame) -> DataFrame:
    """Add ``k``: how often the source was drawn before, counted in chunks of draws."""
    cut = draws.withColumn("_chunk", floor_div(F.col("draw"), _CHUNK))
    inside = Window.partitionBy("source_ordinal", "_chunk").orderBy("draw")
    earlier = Window.partitionBy("source_ordinal").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("source_ordinal", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.select("source_ordinal", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = cut.withColumn("_row", F.row_number().over(inside) - 1)
    return local.join(before, ["source_ordinal", "_chunk"]).select(
        "draw", "source_ordinal", (F.col("_row") + F.col("_before")).alias("k")
    )


def blend_interleave(
    datasets: list[DataFrame], order: list[str], probs: list[float], seed: int = 42, strategy: str = "all_exhausted"
) -> DataFrame:
    """Draw rows from the sources by probability; ``draw`` is the output order.

    ``all_exhausted`` stops when every source has been used up once (shorter ones start again),
    ``first_exhausted`` when the first one has. The draw sequence is deterministic in the seed.
    """
    if len(probs) != len(datasets):
        raise ValueError("one probability per dataset is needed")
    if strategy not in ("all_exhausted", "first_exhausted"):
        raise ValueError(f"unknown stopping strategy {strategy!r}")
    spark = datasets[0].sparkSession
    placed = [dense_position(d, order, "_pos") for d in datasets]
    sizes = [d.count() for d in placed]
    if not all(sizes) or min(probs) <= 0:
        raise ValueError("every source needs rows and a positive probability")
    need = max if strategy == "all_exhausted" else min
    total = int(need(n / (p / sum(probs)) for n, p in zip(sizes, probs)) * 1.1) + 64
    last_row = F.element_at(F.array(*[F.lit(n - 1) for n in sizes]), F.col("source_ordinal") + 1)
    while True:
        # The hash sequence is fixed, so a longer table only extends a shorter one.
        counted = materialize(_occurrences(_draws(spark, probs, seed, total)), "draws")
        ends = counted.where(F.col("k") == last_row).agg(
            F.count(F.lit(1)).alias("done"), F.min("draw").alias("first"), F.max("draw").alias("last")
        ).first()
        if ends["done"] == len(sizes) or (strategy == "first_exhausted" and ends["done"]):
            break
        total *= 2
    stop = ends["last"] if strategy == "all_exhausted" else ends["first"]
    size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("source_ordinal") + 1)
    wanted = counted.where(F.col("draw") <= stop).select("draw", "source_ordinal", F.pmod("k", size).alias("_pos"))
    return wanted.join(blend_concat(placed), ["source_ordinal", "_pos"]).drop("_pos")


def chosen_rejected_stack(df: DataFrame, pairs: dict[str, tuple[str, str]], keep=()) -> DataFrame:
    """Chosen rows above rejected rows: one output row per side, in one pass."""
    sides = [
        F.struct(F.lit(i).alias("side"), *[F.col(cols[i]).alias(name) for name, cols in pairs.items()])
        for i in (0, 1)
    ]
    return df.select(*keep, F.explode(F.array(*sides)).alias("_s")).select(
        *keep, "_s.side", *[f"_s.{name}" for name in pairs]
    )


def regroup_by_prompt(df: DataFrame, prompt: str = "prompt", position: str = "position") -> DataFrame:
    """Rows of a prompt next to each other, prompts in first-seen order, as ``group_position``."""
    first = with_group_stats(df, [prompt], {"_first": F.min(position)})
    return dense_position(first, ["_first", position], "group_position").drop("_first")
