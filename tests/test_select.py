"""Joins, feature arithmetic and selectors: missing values, ties, thresholds and plans."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from prefspark.functions import scores as S
from prefspark.operators import features as FE
from prefspark.operators import joins as J
from prefspark.operators import select as K
from prefspark.operators import positions
from prefspark.operators.positions import prune_to_tail, top_k, top_k_per
from prefspark.schema import nan_to_null

NAN = float("nan")


def ids(df, col="pair_id"):
    return [r[0] for r in df.select(col).collect()]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_missing_discrepancy_is_neither_kept_nor_flipped(spark):
    rows = [(1, 25.0, 1.0), (2, NAN, 9.0), (3, None, 8.0), (4, 20.0, 7.0), (5, -20.0, 6.0), (6, -20.5, -5.0)]
    df = spark.createDataFrame(rows, "pair_id long, rad double, ang double").withColumns(
        {"chosen": F.lit("c"), "rejected": F.lit("r")}
    )
    out = K.select_rad_ang(df, 10, 20.0).select("pair_id", "chosen", "ang").collect()
    assert [tuple(r) for r in out] == [(6, "r", 5.0), (1, "c", 1.0)]


def test_nan_scores_sort_last(spark):
    df = spark.createDataFrame([(1, NAN), (2, 1.0), (3, None), (4, 2.0)], "pair_id long, im double")
    assert ids(K.select_im(df, 4)) == [4, 2, 1, 3]


def test_flipped_rows_lose_ties(spark):
    df = spark.createDataFrame([(1, -30.0, -4.0), (2, 30.0, 4.0)], "pair_id long, rad double, ang double")
    assert ids(K.select_rad_ang(df, 2, 20.0)) == [2, 1]


def test_flip_swaps_and_negates_but_keeps_signals(spark):
    df = spark.createDataFrame(
        [(1, "c", "r", 3, 5, 2, 7.0, 4.0, 1.5)],
        "pair_id long, chosen string, rejected string, chosen_len int, rejected_len int, len_gap int, rad double, im double, ang double",
    )
    row = K.flip_columns(df).first()
    assert tuple(row) == (1, "r", "c", 5, 3, -2, 7.0, 4.0, -1.5)


@pytest.mark.parametrize("one_task", [positions.ONE_TASK, 50])
@pytest.mark.parametrize("k,parts", [(1, 37), (7, 37), (1500, 37), (5000, 3000), (20000, 37)])
def test_top_k_equals_ordered_limit(spark, k, parts, one_task, monkeypatch):
    monkeypatch.setattr(positions, "ONE_TASK", one_task)
    rng = random.Random(k)
    rows = [(i, float(rng.randrange(40)) if rng.random() > 0.05 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "pair_id long, v double").repartition(parts)
    got = [tuple(r) for r in top_k(df, F.col("v"), ["pair_id"], k).collect()]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]
    assert got == want


def test_top_k_beyond_a_million(spark):
    df = spark.range(1_300_000, numPartitions=16).select(F.col("id").alias("pair_id"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    got = top_k(df, F.col("v"), ["pair_id"], 1_100_000).agg(F.count(F.lit(1)), F.sum("v")).first()
    want = df.orderBy(F.desc("v"), "pair_id").limit(1_100_000).agg(F.count(F.lit(1)), F.sum("v")).first()
    assert tuple(got) == tuple(want)


@pytest.mark.parametrize("k", [10, 3000])
def test_few_more_than_k_rows_survive(spark, k, monkeypatch):
    df = spark.range(50000).select(F.col("id").alias("pair_id"), F.xxhash64("id").cast("double").alias("im"))
    kept, bound, _ = prune_to_tail(df, F.col("im"), k)
    assert k <= kept.count() <= bound <= 1.3 * k + 30
    # Beyond the rows of one task nothing meets in one.
    monkeypatch.setattr(positions, "ONE_TASK", 5)
    text = plan(kept) + plan(K.select_im(df, k))
    assert not any(x in text for x in ("TakeOrderedAndProject", "CollectLimit", "GlobalLimit", "WindowGroupLimit"))


def test_a_millionth_and_heavy_ties(spark, monkeypatch):
    monkeypatch.setattr(positions, "ONE_TASK", 20)
    df = spark.range(2_000_000, numPartitions=8).select(F.col("id").alias("pair_id"), F.xxhash64("id").alias("v"))
    kept, bound, _ = prune_to_tail(df, F.col("v"), 2)
    assert 2 <= kept.count() <= bound <= 20
    # All but a few rows tie: of those the first by id are found without sorting the others.
    tied = df.select("pair_id", F.greatest(F.lit(0), 4 - F.col("pair_id")).alias("v"))
    rows = [r.pair_id for r in top_k(tied, F.col("v"), ["pair_id"], 100).collect()]
    assert rows == list(range(100))
    odd = tied.withColumn("pair_id", F.when(F.col("pair_id") != 9, F.col("pair_id")))  # a missing tie comes first
    rows = [r.pair_id for r in top_k(odd.where("pair_id < 3000 OR pair_id IS NULL"), F.col("v"), ["pair_id"], 100).collect()]
    assert rows == [0, 1, 2, 3, None, *(i for i in range(4, 100) if i != 9)]


def test_a_filter_does_not_repeat_the_key(spark):
    rows = spark.range(300_000).selectExpr("id AS pair_id", "(id * 41 % 801 - 400) / 1e1 AS im", "(id * 29 % 401 - 200) / 1e1 AS em_margin")
    top = K.select_joint(rows, 40)
    text = top._jdf.queryExecution().optimizedPlan().toString()
    assert not any("greatest" in line for line in text.splitlines() if "Filter" in line)
    # More rows than that tie at one: the first by id belong.
    ties = rows.where("em_margin > -2 AND im >= 30").orderBy("pair_id").limit(40)
    assert [(r.pair_id, r.joint_prob) for r in top.collect()] == [(r.pair_id, 1.0) for r in ties.collect()]
    assert top.columns == ["pair_id", "im", "em_margin", "joint_prob"]


def test_top_k_per_group(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), float(rng.randrange(50)) if rng.random() > 0.1 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "pair_id long, g int, v double").repartition(9)
    got = [tuple(r) for r in top_k_per(df, ["g"], F.col("v"), ["pair_id"], 70).collect()]
    want = []
    for g in range(3):
        want += sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[:70]
    assert got == want


def test_joint_probability(spark):
    rows = [(30.0, -2.0), (30.0, 30.0), (14.0, 14.0), (None, 1.0), (99.0, 6.0)]
    df = spark.createDataFrame(rows, "em double, im double")
    got = [r[0] for r in df.select(S.joint_score(F.col("em"), F.col("im"))).collect()]
    assert got == [None, 1.0, 0.5, None, 1.0]


def test_features_survive_empty_answers(spark):
    df = spark.createDataFrame(
        [(1, -4.0, -6.0, 2, 3), (2, -1.0, -1.0, 0, 1)],
        "pair_id long, ref_chosen_logprob double, ref_rejected_logprob double, chosen_len int, rejected_len int",
    )
    rows = FE.ref_logprob_features(df).collect()
    assert [r.pair_id for r in rows] == [1]
    assert rows[0].ang == 0.0 and rows[0].original_avg_chosen_logprobs == -2.0


PAIR = "prompt string, chosen string, rejected string"


def test_rad_join_multiplies_duplicates_and_counts_misses(spark):
    im = spark.createDataFrame([("p", "c", "r", 1.0), ("p", "c", "x", NAN)], PAIR + ", margin double")
    rad = spark.createDataFrame([("p", "c", "r", 30.0), ("p", "c", "r", 31.0)], PAIR + ", margin double")
    seen = Observation()
    rows = J.merge_im_rad(im, rad, counts=seen).collect()
    assert sorted((r.rejected, r.im, r.rad) for r in rows) == [("r", 1.0, 30.0), ("r", 1.0, 31.0), ("x", None, None)]
    assert seen.get == {"unmatched": 1}


def test_key_keeps_text_boundaries(spark):
    left = spark.createDataFrame([("a", "bc", "d")], PAIR + "")
    right = spark.createDataFrame([("ab", "c", "d", 1.0)], PAIR + ", em double")
    assert J.merge_em(left, right).first().em is None


def test_overlapping_columns_fail_early(spark):
    left = spark.createDataFrame([("a", "b", "c", 1.0)], PAIR + ", em double")
    with pytest.raises(ValueError, match="both sides"):
        J.merge_em(left, left)
    with pytest.raises(ValueError, match="need one of"):
        J.merge_im_rad(left, left)


def test_nan_to_null(spark):
    df = spark.createDataFrame([(NAN, 1)], "x double, n int")
    assert tuple(nan_to_null(df).first()) == (None, 1)


def test_methods(spark):
    assert K.parse_methods("default") == ["rad_ang"]
    assert K.parse_methods(" IM, rip,") == ["im", "rip"]
    assert len(K.parse_methods("all")) == 8
    with pytest.raises(ValueError, match="unknown methods"):
        K.parse_methods("im,nope")
    assert (S.tau_for_model("mistral"), S.tau_for_model("other")) == (80.0, 20.0)


def test_curriculum(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, None)], "pair_id long, ang double")
    hard = K.order_curriculum(df, "hard-to-easy").orderBy("position")
    assert ids(hard) == [1, 2, 3]
    assert ids(K.order_curriculum(df, "easy-to-hard").orderBy("position")) == [2, 1, 3]
    assert K.order_curriculum(df, "random") is df
    with pytest.raises(ValueError):
        K.order_curriculum(df, "sideways")


def test_dynamic_filter_bounds_are_strict(spark):
    rows = [(1, 0.0), (1, 0.0), (2, 1.0), (2, 0.0), (3, 1.0), (3, 1.0), (4, 0.5)]
    df = spark.createDataFrame(rows, "prompt_id long, score double")
    assert sorted(set(ids(K.dynamic_filter(df, 2), "prompt_id"))) == [2]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    one, two, other = (sorted(ids(K.sample_n(df, 100, s, "id"), "id")) for s in (1, 1, 2))
    assert one == two != other and len(one) == 100


@pytest.mark.parametrize("values,k", [(40, 5), (40, 1200), (3, 1200), (1, 5), (10**9, 5), (10**9, 1200), (10**9, 8000)])
def test_pruning_keeps_the_top(spark, values, k):
    rng = random.Random(values + k)
    rows = [(i, float(rng.randrange(values)) if rng.random() > 0.2 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "pair_id long, im double").repartition(7)
    got = [tuple(r) for r in K.select_im(df, k).collect()]
    assert got == sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]


def test_pruning_drops_most_rows_and_survives_empty_input(spark):
    df = spark.range(50000).select(F.col("id").alias("pair_id"), F.xxhash64("id").cast("double").alias("im"))
    assert 100 <= prune_to_tail(df, F.col("im"), 100)[0].count() <= 200
    assert prune_to_tail(df.limit(0), F.col("im"), 100)[0].count() == 0


def test_pruning_ascending(spark):
    df = spark.range(3000).select(F.col("id").alias("pair_id"), (F.col("id") * 1.0).alias("ang"))
    assert ids(K.rank_by_ang(df, 4, descending=False)) == [0, 1, 2, 3]
