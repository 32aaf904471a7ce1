"""Positions and running sums, with one group that owns most rows."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark.operators import positions as P
from prefspark.operators.groups import with_group_stats
from prefspark.operators.joins import attach_rewards
from prefspark.operators.shaping import kto_unmatched_pairs


def test_dense_position(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(5), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(11)
    got = {(r.a, r.b): r.position for r in P.dense_position(df, [F.col("a").desc(), "b"], parts=6).collect()}
    assert got == {r: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}


def test_dense_position_of_nothing(spark):
    assert P.dense_position(spark.range(0), ["id"]).count() == 0


def test_running_sums_split_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 30}" if i % 2 else None, i, i % 7) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(9)
    out = P.running_sums(df, ["t"], {"total": F.col("v"), "n": F.lit(1)}, groups=["g"], parts=8)
    got = {(r.g, r.t): (r.total, r.n) for r in out.collect()}
    want, state = {}, {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        total, n = state.get(g, (0, 0))
        state[g] = want[g, t] = (total + v, n + 1)
    assert got == want


def test_running_sums_put_one_group_in_several_tasks(spark):
    df = spark.range(10000).select(F.lit("one").alias("g"), F.col("id").alias("t"))
    placed = df.repartitionByRange(8, "g", "t").groupBy(F.spark_partition_id().alias("p")).count()
    assert placed.count() >= 4


def test_hot_group_of_a_statistics_join_is_split(spark):
    """AQE cuts the hot group's partition when it exceeds the skew threshold."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(200000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.rand(1).alias("x")
        )
        out = with_group_stats(rows, ["g"], {"n": F.count(F.lit(1))})
        assert sum(r.n == 66667 for r in out.collect()) == 66667
        assert "skew=true" in out._jdf.queryExecution().executedPlan().treeString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("n,ranks", [(10, 3), (12, 4), (2, 5), (1, 4)])
@pytest.mark.parametrize("drop_last", [False, True])
def test_epoch_shards(spark, n, ranks, drop_last):
    df = spark.range(n).withColumnRenamed("id", "i")
    got = P.epoch_shards(df, ranks, drop_last, index="i").orderBy("step", "rank")
    rows = [tuple(r) for r in got.select("i", "rank", "step").collect()]
    per_rank = -(-(n - ranks) // ranks) if drop_last and n % ranks else -(-n // ranks)
    order = (list(range(n)) * (ranks + 1))[: max(per_rank, 0) * ranks]
    assert rows == [(v, s % ranks, s // ranks) for s, v in enumerate(order)]


def test_epoch_order_depends_on_seed_and_epoch(spark):
    df = spark.range(50)

    def order(seed, epoch):
        return [r.id for r in P.epoch_order(df, "id", seed, epoch).orderBy("epoch_index").collect()]

    assert order(1, 2) == order(1, 2) == order(2, 1)
    assert order(1, 2) != order(1, 3)
    assert sorted(order(1, 3)) == list(range(50))


def test_holdout(spark):
    df = spark.range(1000).withColumnRenamed("id", "position")
    assert P.holdout_head(df, 100).count() == 10
    assert P.holdout_head(df, 4).count() == 4


def test_unmatched_pair_of_a_single_row_batch(spark):
    rows = [(i, f"p{i}", f"r{i}", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "position long, prompt string, response string, label int")
    out = kto_unmatched_pairs(df, 2).where("label = -1").orderBy("position")
    assert [r.response for r in out.collect()] == ["r1", "r0", "r3", "r2", "r4"]


def test_rewards_default_scores_and_overwrite_info(spark):
    samples = spark.createDataFrame([(1, {"reward": -1.0, "old": 2.0})], "sample_id long, info map<string,double>")
    rewards = spark.createDataFrame([(1, 0.5)], "sample_id long, rewards double")
    row = attach_rewards(samples, rewards).first()
    assert (row.score, row.info) == (0.5, {"old": 2.0, "score": 0.5, "reward": 0.5})


def test_rows_without_a_group_key_are_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (2, 5)], "g int, x int")
    rows = with_group_stats(df, ["g"], {"n": F.count(F.lit(1)), "top": F.max("x")}).collect()
    assert sorted((r.x, r.g, r.n, r.top) for r in rows) == [(1, None, 2, 3), (3, None, 2, 3), (5, 2, 1, 5)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 50, 1000, 4097, 20_000])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select("id", P.permuted(F.col("id"), n, 7).alias("to"), P.permuted(F.col("id"), n, 8).alias("other"))
    df = df.withColumn("back", P.permuted(F.col("to"), n, 7, back=True))
    rows = df.collect()
    assert sorted(r.to for r in rows) == sorted(r.other for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n >= 1000:
        assert sum(r.to == r.id for r in rows) < 20 and sum(r.to == r.other for r in rows) < 20
        halves = sum(r.to < n // 2 for r in rows if r.id < n // 2)
        assert abs(halves - n / 4) < 5 * n**0.5
        near = sum(abs(x.to - y.to) == 1 for x, y in zip(sorted(rows, key=lambda r: r.id), sorted(rows, key=lambda r: r.id)[1:]))
        assert near < 30


def test_an_epoch_moves_no_rows(spark):
    df = P.epoch_places(spark.range(100).withColumnRenamed("id", "position"), 100, 3, 1)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    out = P.epoch_shards(df, 3).collect()
    assert sorted(r.step * 3 + r["rank"] for r in out) == list(range(102))
