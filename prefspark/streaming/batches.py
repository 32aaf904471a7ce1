"""Dynamic filtering of rollout groups on a stream.

Stage one collects the samples of a prompt in Spark's own streaming aggregate and tests their mean score when the
watermark has passed the round that made them. Stage two cuts the kept groups into batches, which end with a round; what
it has to know of earlier micro-batches is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators.positions import dense_position, running_sums
from prefspark.operators.rounds import full_batches
from prefspark.session import materialize
from prefspark.sources.readers import _exists

SAMPLE = T.StructType(
    [
        T.StructField("prompt_id", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("created", T.TimestampType()),
    ]
)
GROUPS = "batch long, place long, created timestamp, prompt_id long, first_position long, n long, mean_score double, epoch long"
LEDGER = "batches long, held long, seen long, all_kept long, all_seen long, epoch long"


def group_verdicts(
    stream: DataFrame, n: int, low: float = 0.0, high: float = 1.0, created: str = "created", delay: str = "10 minutes"
) -> DataFrame:
    """One row per group (prompt_id, sample position, score in), once the watermark has passed it: its mean score and verdict.

    ``created`` is the time of the round that a group belongs to, the same for all of its samples. Samples may come in any
    order, more than once, and up to ``delay`` late; what comes later is dropped, so verdicts do not depend on how the
    input is cut into micro-batches. A group is kept if it has just ``n`` samples and its mean lies strictly inside the range. All
    state is that of rounds within the delay, and expires by the watermark.
    """
    samples = stream.select("prompt_id", "position", "score", F.col(created).alias("created")).withWatermark("created", delay)
    groups = (
        samples.dropDuplicatesWithinWatermark(["prompt_id", "position"])
        .groupBy("created", "prompt_id")
        .agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    )
    inside = (F.col("mean_score") > low + 1e-6) & (F.col("mean_score") < high - 1e-6)
    return groups.withColumn("kept", (F.col("n") == n) & F.coalesce(inside, F.lit(False)))


def _ledger(spark: SparkSession, out_dir: str, epoch: int) -> dict:
    """What earlier micro-batches left: full batches, groups and samples of the unfinished one, and totals."""
    path = f"{out_dir}/ledger/epoch={epoch - 1}"
    if epoch and _exists(spark, path):
        return spark.read.schema(LEDGER.rsplit(",", 1)[0]).parquet(path).first().asDict()
    return {"batches": 0, "held": 0, "seen": 0, "all_kept": 0, "all_seen": 0}


def batch_groups_of(out_dir: str, n: int, batch_groups: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: store kept groups with their batch and place, running on across micro-batches.

    Every micro-batch overwrites its own folders and starts from the ledger row of the one before it, so its cost does not grow
    with the stream and a repeated micro-batch gives the same result.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        verdicts = materialize(batch, "verdicts")  # the state operator runs once
        old = _ledger(spark, out_dir, epoch)
        rounds = verdicts.groupBy("created").agg(F.count_if("kept").alias("_k"), F.sum("n").alias("_s"))
        new = rounds.agg(F.sum("_k"), F.sum("_s")).first()
        kept, seen = old["held"] + (new[0] or 0), old["seen"] + (new[1] or 0)
        if new[0] is None:
            full, last = [], (0, 0)
            groups = spark.createDataFrame([], GROUPS.rsplit(",", 1)[0])
        else:
            sums = {"kept": F.col("_k"), "seen": F.col("_s")}
            ends = running_sums(rounds, ["created"], sums).withColumns({c: F.col(c) + old[h] for c, h in (("kept", "held"), ("seen", "seen"))})
            batches = materialize(full_batches(ends, batch_groups), "full-batches")
            count, *last = batches.agg(F.count(F.lit(1)), F.max("end_kept"), F.max("end_seen")).first()
            full, last = count, tuple(x or 0 for x in last)
            rate = F.lit(100.0 * n) * (F.col("end_kept") - F.col("start_kept")) / (F.col("end_seen") - F.col("start_seen"))
            rates = batches.select((F.col("batch") + old["batches"]).alias("batch"), rate.alias("pass_rate"))
            rates.write.mode("overwrite").parquet(f"{out_dir}/batches/epoch={epoch}")
            # Places of all batches, the unfinished one's too; a group beyond those of its batch is surplus.
            start = F.explode(F.sequence(F.col("start_kept") + 1, F.col("start_kept") + batch_groups)).alias("_order")
            places = batches.select("batch", "start_kept", start)
            order = dense_position(verdicts.where("kept"), ["created", "first_position"], "_row")
            order = order.withColumn("_order", F.col("_row") + (1 + old["held"]))
            done = order.join(places, "_order")
            open_ = order.where(F.col("_order") > last[0]).withColumns({"batch": F.lit(count), "start_kept": F.lit(last[0])})
            groups = done.unionByName(open_).select(
                (F.col("batch") + old["batches"]).cast("long").alias("batch"),
                (F.col("_order") - F.col("start_kept")).cast("long").alias("place"),
                "created", "prompt_id", "first_position", "n", "mean_score",
            )
            groups.write.mode("overwrite").parquet(f"{out_dir}/groups/epoch={epoch}")
        row = (
            old["batches"] + (full or 0), kept - last[0], seen - last[1],
            old["all_kept"] + (new[0] or 0), old["all_seen"] + (new[1] or 0),
        )
        spark.createDataFrame([row], LEDGER.rsplit(",", 1)[0]).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/ledger/epoch={epoch}")

    return store


def _latest(spark: SparkSession, out_dir: str) -> dict:
    ledger = spark.read.schema(LEDGER).parquet(f"{out_dir}/ledger")
    return ledger.orderBy(F.desc("epoch")).limit(1).first().asDict()


def emitted_batches(spark: SparkSession, out_dir: str) -> DataFrame:
    """Groups of the full batches so far, by ``batch`` and ``place``, with the batch's pass rate."""
    done = _latest(spark, out_dir)["batches"]
    if not done:
        return spark.createDataFrame([], f"{GROUPS}, pass_rate double")
    groups = spark.read.schema(GROUPS).parquet(f"{out_dir}/groups").where(F.col("batch") < done)
    rates = spark.read.schema("batch long, pass_rate double, epoch long").parquet(f"{out_dir}/batches")
    return groups.join(rates.select("batch", "pass_rate"), "batch")


def pass_rate(spark: SparkSession, out_dir: str, n: int) -> float | None:
    """Samples of kept groups in percent of all samples so far."""
    row = _latest(spark, out_dir)
    return 100.0 * n * row["all_kept"] / row["all_seen"] if row["all_seen"] else None


def run_dynamic_batches(
    stream: DataFrame, n: int, batch_groups: int, out_dir: str, low: float = 0.0, high: float = 1.0, delay: str = "10 minutes"
) -> DataFrame:
    """Drive the stream over all available input and return the emitted groups."""
    query = (
        group_verdicts(stream, n, low, high, delay=delay)
        .writeStream.outputMode("append")
        .foreachBatch(batch_groups_of(out_dir, n, batch_groups))
        .option("checkpointLocation", f"{out_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return emitted_batches(stream.sparkSession, out_dir)
