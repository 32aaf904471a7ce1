"""Token arithmetic on ragged arrays."""

import math

import pytest
from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions import losses as L
from prefspark.functions import scalars as C
from prefspark.functions import scores as S
from prefspark.operators import advantages as W
from prefspark.operators import objective as O
from prefspark.operators import reward as R
from prefspark.operators import shaping as T


def one(df, col):
    return df.select(col.alias("x")).first()["x"]


def suffix(xs, decay):
    out, acc = [], 0.0
    for x in reversed(xs):
        acc = x + decay * acc
        out.append(acc)
    return out[::-1]


def test_suffix_scan_on_ragged_null_and_empty_arrays(spark):
    rows = [[float(i + j) for j in range(i % 7)] for i in range(40)]
    data = [(i, r) for i, r in enumerate(rows)] + [(99, None)]
    df = spark.createDataFrame(data, "i int, x array<double>").repartition(3)
    got = {r.i: r.y for r in df.select("i", A.discounted_suffix(F.col("x"), 0.5).alias("y")).collect()}
    assert got.pop(99) is None
    assert got == {i: pytest.approx(suffix(r, 0.5)) for i, r in enumerate(rows)}


def test_gae_masks_values_and_rewards_first(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [0.5, 0.25, 1.0], [1, 0, 1]), ([], [], [])], "v array<double>, r array<double>, m array<int>"
    )
    adv, ret = W.gae(F.col("v"), F.col("r"), F.col("m"), 0.9, 0.8)
    rows = df.select(adv.alias("a"), ret.alias("t")).collect()
    v, r = [1.0, 0.0, 3.0], [0.5, 0.0, 1.0]
    delta = [r[t] + 0.9 * (v[t + 1] if t < 2 else 0.0) - v[t] for t in range(3)]
    want = suffix(delta, 0.72)
    assert rows[0].a == pytest.approx(want)
    assert rows[0].t == pytest.approx([a + x for a, x in zip(want, v)])
    assert rows[1].a == [] and rows[1].t == []


def test_token_reward_lands_on_last_action_token(spark):
    df = spark.createDataFrame(
        [([0.1, 0.2, 0.3], [1, 1, 0]), ([0.1, 0.2, 0.3], [0, 0, 0]), ([], [])], "kl array<double>, m array<int>"
    )
    rows = df.select(S.per_token_reward(F.lit(9.0), F.col("kl"), F.col("m"), 1.0, (-5, 5)).alias("r")).collect()
    assert rows[0].r == pytest.approx([-0.1, 4.8, -0.3])
    # without any action token the first maximum of the reversed mask is its first cell: the last token
    assert rows[1].r == pytest.approx([-0.1, -0.2, 4.7])
    assert rows[2].r == []
    negative = df.select(S.per_token_reward(F.lit(1.0), F.col("kl"), F.col("m"), -3.0).alias("r")).first()
    assert negative.r == pytest.approx([0.0, 1.0, 0.0])


def test_span_logprob_edges(spark):
    df = spark.range(1).select(
        F.array(*[F.lit(-float(x)) for x in (1, 2, 4, 8)]).alias("lp"), F.array(*[F.lit(x) for x in (5, 2, 6, 7)]).alias("y")
    )

    def total(p, r, pad=2):
        return one(df, S.span_logprob(F.col("lp"), F.col("y"), F.lit(p), F.lit(r), pad))

    assert total(2, 2) == -4.0  # the pad label inside the span does not count
    assert total(2, 99) == -12.0  # past the end
    assert total(3, 0) == 0.0 and total(9, 2) == 0.0  # empty span
    assert total(0, 2) == -1.0


def test_masked_normalize_moves_masked_cells_as_well(spark):
    df = spark.createDataFrame([([2.0, 4.0, 7.0], [1, 1, 0])], "x array<double>, m array<int>")
    assert one(df, A.masked_normalize(F.col("x"), F.col("m"))) == pytest.approx([-1.0, 1.0, -3.0])


def test_kl_estimators_and_clamp(spark):
    df = spark.range(1)
    got = [one(df, S.approx_kl(F.lit(-1.0), F.lit(-3.0), k)) for k in ("k1", "k2", "k3")]
    assert got == pytest.approx([2.0, 2.0, math.exp(-2) + 1])
    assert one(df, S.approx_kl(F.lit(0.0), F.lit(-50.0))) == 10.0
    with pytest.raises(ValueError):
        S.approx_kl(F.lit(0.0), F.lit(0.0), "k4")


def test_log_sigmoid_is_stable(spark):
    df = spark.range(1)
    assert one(df, C.log_sigmoid(F.lit(-800.0))) == -800.0
    assert one(df, C.log_sigmoid(F.lit(800.0))) == 0.0
    assert one(df, L.log_exp(F.lit(0.0), F.lit(900.0))) == 900.0


def test_clip_keeps_null(spark):
    assert one(spark.range(1), C.clip(F.lit(None).cast("double"), -1.0, 1.0)) is None


def test_distillation_ignores_infinite_student_logits(spark):
    df = spark.createDataFrame([([0.0, float("-inf")], [0.0, 0.0])], "s array<double>, t array<double>")
    assert one(df, L.distillation(F.col("s"), F.col("t"))) == pytest.approx(0.0)


def test_overlong_penalty(spark):
    df = spark.createDataFrame([(80,), (90,), (95,), (120,)], "n int")
    got = [r[0] for r in df.select(S.overlong_penalty(F.col("n"), 100, 10, 2.0)).collect()]
    assert got == [0.0, 0.0, -1.0, -2.0]
    with pytest.raises(ValueError):
        S.overlong_penalty(F.col("n"), 5, 10)


def test_group_std_of_one_sample_is_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0)], "prompt_id long, reward double")
    rows = {(r.prompt_id, r.reward): r.group_reward_std for r in R.group_reward_std(df).collect()}
    assert rows[1, 2.0] is None and rows[2, 1.0] == pytest.approx(math.sqrt(2))


def test_estimators(spark):
    df = spark.createDataFrame(
        [(1, 1.0, [0.0, 0.0], [1, 1]), (1, 3.0, [0.0, 0.0], [1, 1])],
        "prompt_id long, reward double, kl array<double>, action_mask array<int>",
    )

    def run(name, **options):
        out = W.compute_advantages(df, name, **options).orderBy("reward")
        return [r.advantages for r in out.collect()]

    assert run("rloo", gamma=0.5) == [[-2.0, -2.0], [2.0, 2.0]]
    assert run("dr_grpo") == run("reinforce_baseline") == [[-1.0, -1.0], [1.0, 1.0]]
    assert run("reinforce", gamma=0.5) == [[0.5, 1.0], [1.5, 3.0]]
    with pytest.raises(ValueError, match="unknown advantage"):
        run("nope")


def test_normalized_advantages(spark):
    df = spark.createDataFrame([([1.0, 3.0], [1, 1]), ([99.0], [0])], "advantages array<double>, action_mask array<int>")
    out = W.normalize_advantages_global(df).collect()
    assert out[0].advantages == pytest.approx([-1.0, 1.0]) and out[1].advantages == pytest.approx([97.0])
    plain = W.normalize_advantages_global(df, scale=False).collect()
    assert plain[0].advantages == pytest.approx([-1.0, 1.0])


def test_adaptive_kl_with_negative_and_zero_factors(spark):
    rows = [("a", 0, 9.0, 10), ("a", 1, 0.0, 10), ("a", 2, 0.0, 5), ("a", 3, 9.0, 1), ("b", 0, 0.0, 10)]
    df = spark.createDataFrame(rows, "run_id string, step int, kl double, n_steps int")
    got = {(r.run_id, r.step): r.kl_coef for r in W.adaptive_kl(df, 1.0, 1.0, 1.0).collect()}
    want, value = {}, {}
    for run, step, kl, n in rows:
        factor = 1 + min(max(kl / 1.0 - 1, -0.2), 0.2) * n / 1.0
        value[run] = value.get(run, 1.0) * factor
        want[run, step] = value[run]
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_reward_formatting_matches_python(spark):
    rewards = [0.125, 2.675, -0.005, 1234567.0, 0.1 + 0.2, -1.5]
    df = spark.createDataFrame([(i, "q", r) for i, r in enumerate(rewards)], "i int, input string, reward double")
    got = [r.input for r in R.conditional_sft(df, "{reward}|{input}").orderBy("i").collect()]
    assert got == ["{:.2f}|q".format(r) for r in rewards]
    with pytest.raises(ValueError):
        R.conditional_sft(df, "{input}")


def test_reward_text_is_replaced_before_the_input(spark):
    df = spark.createDataFrame([("about {reward}", 1.0)], "input string, reward double")
    assert R.conditional_sft(df, "{input}:{reward}").first().input == "about {reward}:1.00"


def test_best_and_worst_take_the_first_of_ties(spark):
    rows = [("q", "a", 1.0, 0), ("q", "b", 1.0, 1), ("s", "only", 2.0, 2)]
    df = spark.createDataFrame(rows, "input string, output string, reward double, position long")
    assert {r.input: r.output for r in R.best_of_n(df).collect()} == {"q": "a", "s": "only"}
    pairs = {r.prompt: (r.chosen, r.rejected) for r in R.iterative_pairs(df).collect()}
    assert pairs == {"q": ("a", "a"), "s": ("only", "only")}
    with pytest.raises(ValueError, match="post-processor"):
        R.get_processor("x")


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-10.0,), (10.0,), (9.9,), (10.1,), (None,)], "r double")
    rows = {r.bin: r.n for r in R.reward_histogram(df, "r").collect()}
    assert rows == {1: 1, 10: 2}


def test_accuracy_is_strict(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (2.0, 1.0, 0), (2.0, 1.0, 1)], "c double, r double, b int")
    assert R.preference_accuracy(df, "c", "r").first().acc == pytest.approx(2 / 3)
    assert R.preference_accuracy(df, "c", "r", "b").first().acc == 0.75


def test_kto_label_minus_one_gives_the_kl(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1), (3.0, 1.0, -1), (0.0, 4.0, 0)], "policy_logp double, ref_logp double, label int")
    row = O.kto_loss(df, 1.0).first()
    good, bad = 1 - 1 / (1 + math.exp(1.0)), 1 - 1 / (1 + math.exp(-6.0))
    assert row.kl == 2.0 and row.loss == pytest.approx((good + bad) / 2)


def test_reward_hook_runs_in_chunks(spark):
    def rate(queries, prompts, labels):
        assert len(queries) <= 3
        return {"rewards": [float(q) for q in queries]}

    df = spark.range(10).selectExpr("id AS sample_id", "CAST(id AS STRING) AS query", "'p' AS prompt", "'' AS label")
    rows = R.apply_reward_func(df, rate, chunk=3).collect()
    assert sorted((r.sample_id, r.rewards, r.scores) for r in rows) == [(i, float(i), float(i)) for i in range(10)]


def test_assembled_text_and_truncation(spark):
    df = spark.createDataFrame([("p", "r\n\n"), ("p\n", "\n r</s>"), ("p", "")], "p string, r string")
    got = [r[0] for r in df.select(T.assemble_text(F.col("p"), F.col("r"), "</s>")).collect()]
    assert got == ["pr </s>", "p\n\n r</s>", "p </s>"]
    ids = spark.createDataFrame([([5, 6, 7],), ([5],), ([],)], "ids array<int>")
    assert [r[0] for r in ids.select(T.truncate_with_eos(F.col("ids"), 2, 2)).collect()] == [[5, 2], [2], []]


def test_step_labels(spark):
    df = spark.createDataFrame([([1, 9, 2, 9], [0.5, 1.0, 7.0]), ([1], [3.0])], "ids array<int>, y array<double>")
    rows = [r[0] for r in df.select(T.process_reward_labels(F.col("ids"), F.col("y"), 9)).collect()]
    assert rows == [[-100.0, 0.5, -100.0, 1.0], [-100.0]]
    with pytest.raises(Exception, match="fewer step labels"):
        df.select(T.process_reward_labels(F.col("ids"), F.array(F.lit(1.0)), 9)).collect()
    words = spark.createDataFrame([(["+", "-"],)], "y array<string>")
    assert one(words, T.reward_label_ids(F.col("y"), {"+": 11, "-": 12})) == [11, 12]
    with pytest.raises(Exception, match="not among the reward tokens"):
        words.select(T.reward_label_ids(F.col("y"), {"+": 11})).collect()


def test_template_without_placeholder_is_ignored(spark):
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.warns(UserWarning):
        assert one(df, T.format_template(F.col("t"), "no slot")) == "x"
    with pytest.raises(ValueError):
        T.format_template(F.col("t"), "{} and {}")


def test_loss_mask(spark):
    df = spark.createDataFrame([(5, 2), (3, 1), (3, 0), (0, 1)], "n int, p int")
    got = [r[0] for r in df.select(T.sft_loss_mask(F.col("n"), F.col("p"))).collect()]
    assert got == [[0, 1, 1, 1, 0], [1, 1, 0], [0, 0, 0], []]


def test_range_mask(spark):
    df = spark.createDataFrame(
        [(8, [(2, 4), (6, 9)]), (3, []), (0, [(1, 2)]), (5, [(0, 2), (3, 4)]), (4, [(0, 4)]), (4, [(4, 3), (4, 9)])], "n int, r array<struct<start:int,end:int>>"
    )
    got = [r[0] for r in df.select(T.ranges_loss_mask(F.col("n"), F.col("r"))).collect()]
    want = []
    for n, ranges in ((8, [(2, 4), (6, 9)]), (3, []), (0, [(1, 2)]), (5, [(0, 2), (3, 4)]), (4, [(0, 4)]), (4, [(4, 3), (4, 9)])):
        mask = [0] * n
        for start, end in ranges:
            for i in range(n)[start - 1 : end]:
                mask[i] = 1
        want.append(mask)
    assert got == want
