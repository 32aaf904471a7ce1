"""Queries: scored responses, rollout arithmetic and objective metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions import losses as L
from prefspark.functions import scores as S
from prefspark.operators import advantages as W
from prefspark.operators import objective as O
from prefspark.operators import reward as R
from prefspark.operators.blend import chosen_rejected_stack
from prefspark.plans.registry import q6, query, r6
from prefspark.plans.views import run_sql, table, view

# ---------------------------------------------------------------------------------------------
# scored responses


@query("a01_best_of_n", """SELECT input, arg_max(output, (reward, -position)) AS output, max(reward) AS reward
FROM v_responses GROUP BY 1""", "v_responses")
def a01(spark, sf):
    return R.best_of_n(view(spark, sf, "v_responses"))


@query("a02_iterative_pairs", """SELECT input AS prompt, arg_max(output, (reward, -position)) AS chosen, max(reward) AS chosen_reward,
arg_min(output, (reward, position)) AS rejected, min(reward) AS rejected_reward FROM v_responses GROUP BY 1""", "v_responses")
def a02(spark, sf):
    return R.iterative_pairs(view(spark, sf, "v_responses"))


_Z = "(reward - (SELECT avg(reward) FROM v_responses)) / (SELECT stddev_samp(reward) FROM v_responses)"


@query("a03_normalize_rewards_global", f"SELECT position, {q6(_Z)} AS reward FROM v_responses", "v_responses")
def a03(spark, sf):
    return R.normalize_rewards_global(view(spark, sf, "v_responses")).select("position", r6("reward").alias("reward"))


@query("a04_conditional_sft", "SELECT position, input || ' <rm_score>: ' || format('{:.2f}', reward) || ' ' AS input, output FROM v_responses", "v_responses")
def a04(spark, sf):
    return R.conditional_sft(view(spark, sf, "v_responses")).select("position", "input", "output")


@query("a05_reward_summary", f"SELECT {q6('avg(reward)', 9)} AS reward_mean, {q6('stddev_samp(reward)')} AS reward_std FROM v_responses", "v_responses")
def a05(spark, sf):
    out = R.reward_summary(view(spark, sf, "v_responses"))
    return out.select(r6("reward_mean", 9).alias("reward_mean"), r6("reward_std").alias("reward_std"))


_REWARDS = "SELECT pair_id, im / 4e0 AS chosen_reward, em_margin / 2e0 AS rejected_reward FROM {v_margins}"
_REWARDS_SQL = _REWARDS.format(v_margins="v_margins")


@query("a06_reward_model_stats", f"""SELECT {q6('avg(r)', 9)} AS mean, {q6('greatest(stddev_samp(r), 1e-8)')} AS std FROM
(SELECT chosen_reward AS r FROM ({_REWARDS_SQL}) UNION ALL SELECT rejected_reward FROM ({_REWARDS_SQL}))""", "v_margins")
def a06(spark, sf):
    return R.reward_model_stats(run_sql(spark, sf, _REWARDS)).select(r6("mean", 9).alias("mean"), r6("std").alias("std"))


@query("a07_reward_histogram", f"""
WITH x AS (SELECT least(CAST(floor((chosen_reward + 10) / 2) AS BIGINT) + 1, 10) AS bin FROM ({_REWARDS_SQL}) WHERE chosen_reward BETWEEN -10 AND 10)
SELECT bin, count(*) AS n, {q6('count(*) / CAST((SELECT count(*) FROM x) AS DOUBLE)')} AS fraction FROM x GROUP BY 1""", "v_margins")
def a07(spark, sf):
    out = R.reward_histogram(run_sql(spark, sf, _REWARDS), "chosen_reward")
    return out.select("bin", "n", r6("fraction").alias("fraction"))


@query("a08_preference_accuracy", f"""SELECT 'rows' AS kind, {q6('avg(CASE WHEN chosen_reward > rejected_reward THEN 1e0 ELSE 0e0 END)', 9)} AS acc FROM ({_REWARDS_SQL})
UNION ALL SELECT 'batches', {q6('avg(a)', 9)} FROM (SELECT avg(CASE WHEN chosen_reward > rejected_reward THEN 1e0 ELSE 0e0 END) AS a
  FROM ({_REWARDS_SQL}) GROUP BY pair_id // 48)""", "v_margins")
def a08(spark, sf):
    rows = run_sql(spark, sf, _REWARDS).withColumn("batch", F.expr("pair_id div 48"))
    one = R.preference_accuracy(rows, "chosen_reward", "rejected_reward")
    two = R.preference_accuracy(rows, "chosen_reward", "rejected_reward", "batch")
    both = one.withColumn("kind", F.lit("rows")).unionByName(two.withColumn("kind", F.lit("batches")))
    return both.select("kind", r6("acc", 9).alias("acc"))


@query("a09_pass_at_k", f"""SELECT datasource, {q6('avg(b)', 9)} AS pass4, {q6('avg(m)', 9)} AS pass1, count(*) AS count FROM
(SELECT prompt_id, datasource, max(score) AS b, avg(score) AS m FROM v_responses GROUP BY 1, 2) GROUP BY 1""", "v_responses")
def a09(spark, sf):
    rows = view(spark, sf, "v_responses").withColumnRenamed("input", "prompt")
    out = R.pass_at_k(rows, rows.select("prompt", "datasource", "position"), 4, reward="score")
    return out.select("datasource", r6("pass4", 9).alias("pass4"), r6("pass1", 9).alias("pass1"), "count")


@query("a10_group_reward_std", f"SELECT position, {q6('stddev_samp(reward) OVER (PARTITION BY prompt_id)')} AS group_reward_std FROM v_responses", "v_responses")
def a10(spark, sf):
    out = R.group_reward_std(view(spark, sf, "v_responses"))
    return out.select("position", r6("group_reward_std").alias("group_reward_std"))


_INFO = "SELECT CAST(FLOOR(position / 256e0) AS BIGINT) AS step, reward, score, 1 + position % 97 AS response_length, reward / 1e2 AS kl, position FROM {v_responses}"
_INFO_SQL = _INFO.format(v_responses="v_responses")


@query("a11_mean_metrics", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {q6('avg(v)', 9)} AS value FROM (SELECT avg({m}) AS v FROM ({_INFO_SQL}) GROUP BY step)"
    for m in ("reward", "score", "kl")), "v_responses")
def a11(spark, sf):
    rows = run_sql(spark, sf, _INFO).selectExpr("step", "map('reward', reward, 'score', score, 'kl', kl) AS info")
    return R.mean_metrics(rows).select("metric", r6("value", 9).alias("value"))


@query("a12_length_weighted_kl", f"SELECT step, {q6('sum(kl * response_length) / sum(response_length)', 9)} AS kl FROM ({_INFO_SQL}) GROUP BY 1", "v_responses")
def a12(spark, sf):
    return R.length_weighted_kl(run_sql(spark, sf, _INFO)).select("step", r6("kl", 9).alias("kl"))


@query("a13_reduce_metrics", " UNION ALL ".join(
    f"SELECT '{op}' AS op, datasource AS metric, {q6(f'{fn}(reward)')} AS value FROM v_responses GROUP BY 2"
    for op, fn in (("mean", "avg"), ("max", "max"), ("sum", "sum"))), "v_responses")
def a13(spark, sf):
    rows = view(spark, sf, "v_responses").selectExpr("datasource AS metric", "reward AS value")
    parts = [R.reduce_metrics(rows, op).withColumn("op", F.lit(op)) for op in ("mean", "max", "sum")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("op", "metric", r6("value").alias("value"))


@query("h01_reward_func", f"SELECT position AS sample_id, {q6('length(output) * 1e0')} AS reward, {q6('length(output) - length(input)')} AS score, length(input) * 1e0 AS prompt_chars FROM v_responses", "v_responses")
def h01(spark, sf):
    def rate(queries, prompts, labels):
        lengths = [len(q) for q in queries]
        return {
            "rewards": lengths,
            "scores": [n - len(p) for n, p in zip(lengths, prompts)],
            "extra_logs": {"prompt_chars": [len(p) for p in prompts]},
        }

    rows = view(spark, sf, "v_responses").selectExpr("position AS sample_id", "output AS query", "input AS prompt", "'' AS label")
    out = R.apply_reward_func(rows, rate)
    return out.select("sample_id", r6("rewards").alias("reward"), r6("scores").alias("score"), F.col("extra_logs")["prompt_chars"].alias("prompt_chars"))


@query("h02_scorer", f"""SELECT pair_id, {q6('-0.5e0 * length(chosen)')} AS policy_chosen_logprob, {q6('-0.75e0 * length(rejected)')} AS policy_rejected_logprob,
{q6('0.125e0 * (length(chosen) - length(rejected)) - 0e0 * 1')} AS margin FROM v_pairs""".replace(
    "0.125e0 * (length(chosen) - length(rejected)) - 0e0 * 1",
    "(-0.5e0 * length(chosen) + 0.75e0 * length(rejected)) - (-0.625e0 * length(chosen) + 0.625e0 * length(rejected))"), "v_pairs")
def h02(spark, sf):
    from prefspark.plans.pipelines import score_margins

    out = score_margins(view(spark, sf, "v_pairs"), R.length_scorer)
    return out.select("pair_id", *[r6(c).alias(c) for c in ("policy_chosen_logprob", "policy_rejected_logprob", "margin")])


@query("h05_post_processors", f"""SELECT 'rs' AS name, count(*) AS n, {q6('sum(m)')} AS total FROM (SELECT max(reward) AS m FROM v_responses GROUP BY input)
UNION ALL SELECT 'iter_dpo', count(*), {q6('sum(m)')} FROM (SELECT max(reward) - min(reward) AS m FROM v_responses GROUP BY input)
UNION ALL SELECT 'csft', count(*), {q6('sum(reward)')} FROM v_responses""", "v_responses")
def h05(spark, sf):
    rows = view(spark, sf, "v_responses")
    value = {"rs": "reward", "iter_dpo": "chosen_reward - rejected_reward", "csft": "reward"}
    parts = [
        R.get_processor(name)(rows).agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.expr(e))).alias("total")).withColumn("name", F.lit(name))
        for name, e in value.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------------------------------------
# rollouts: token tables, one array row per sequence of four tokens


def rollouts(spark, sf):
    fields = ["reward", "value", "action_mask", "logprob", "base_logprob", "label"]
    cells = [F.max(F.when(F.col("t") == i, F.struct("t", *fields))) for i in range(4)]
    rows = view(spark, sf, "v_tokens").groupBy("seq_id").agg(F.array(*cells).alias("_c"))
    rows = rows.withColumn("_c", F.filter("_c", lambda c: c.isNotNull()))
    return rows.select(
        "seq_id",
        F.col("_c.reward").alias("rewards"),
        F.col("_c.value").alias("values"),
        F.col("_c.action_mask").alias("action_mask"),
        F.col("_c.logprob").alias("logprobs"),
        F.col("_c.base_logprob").alias("base_logprobs"),
        F.col("_c.label").alias("labels"),
    )


def _long(df, *cols, digits=6):
    """Array columns back to one row per token, rounded."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    out = df.select("seq_id", F.posexplode(zipped).alias("t", "_z"))
    return out.select("seq_id", "t", *[r6(F.col(f"_z.{c}"), digits).alias(c) for c in cols])


_PLEN = "1 + CAST(FLOOR(seq_id / 4e0) AS BIGINT) % 3"
_RLEN = "CAST(FLOOR(seq_id / 4e0) AS BIGINT) % 5"


@query("f08_span_logprob", f"""SELECT seq_id, {q6(f'sum(CASE WHEN t >= ({_PLEN}) - 1 AND t < ({_PLEN}) + ({_RLEN}) - 1 AND label <> 3 THEN logprob ELSE 0e0 END)')} AS total
FROM v_tokens GROUP BY 1""", "v_tokens")
def f08(spark, sf):
    p, r = F.expr(_PLEN).cast("int"), F.expr(_RLEN).cast("int")
    return rollouts(spark, sf).select("seq_id", r6(S.span_logprob(F.col("logprobs"), F.col("labels"), p, r, 3)).alias("total"))


_KEPT = f"(action_mask * CASE WHEN t + 1 >= {_PLEN} THEN 1 ELSE 0 END)"


@query("f09_sequence_logprob", f"""SELECT seq_id, {q6(f'sum(logprob * {_KEPT})')} AS total, {q6(f'sum(logprob * {_KEPT}) / nullif(sum({_KEPT}), 0)')} AS mean
FROM v_tokens GROUP BY 1""", "v_tokens")
def f09(spark, sf):
    rows = rollouts(spark, sf)
    mask = F.concat(F.array(F.lit(1)), F.col("action_mask"))
    p = F.expr(_PLEN)
    return rows.select(
        "seq_id",
        r6(S.sequence_logprob(F.col("logprobs"), mask, p)).alias("total"),
        r6(S.sequence_logprob(F.col("logprobs"), mask, p, average=True)).alias("mean"),
    )


@query("f10_masked_mean", f"SELECT seq_id, {q6('sum(value * action_mask) / nullif(sum(action_mask), 0)')} AS mean FROM v_tokens GROUP BY 1", "v_tokens")
def f10(spark, sf):
    return rollouts(spark, sf).select("seq_id", r6(A.masked_mean(F.col("values"), F.col("action_mask"))).alias("mean"))


@query("f11_masked_normalize", f"""
WITH m AS (SELECT *, value * action_mask AS x, sum(action_mask) OVER w AS n, sum(value * action_mask) OVER w / nullif(sum(action_mask) OVER w, 0) AS mu FROM v_tokens WINDOW w AS (PARTITION BY seq_id)),
c AS (SELECT *, sum((x - mu) * (x - mu) * action_mask) OVER (PARTITION BY seq_id) / nullif(n, 0) AS v FROM m)
SELECT seq_id, t, {q6('(x - mu) / sqrt(greatest(v, 1e-8))')} AS normed FROM c""", "v_tokens")
def f11(spark, sf):
    rows = rollouts(spark, sf).withColumn("normed", A.masked_normalize(F.col("values"), F.col("action_mask")))
    return _long(rows, "normed")


_D = "(logprob - base_logprob)"


def _clamp(x: str) -> str:
    return f"greatest(least({x}, 10e0), -10e0)"


@query("f12_approx_kl", f"""SELECT seq_id, t, {q6(_clamp(_D), 9)} AS k1, {q6(_clamp(f'{_D} * {_D} / 2e0'), 9)} AS k2,
{q6(_clamp(f'exp(-{_D}) - 1 + {_D}'), 9)} AS k3 FROM v_tokens""", "v_tokens")
def f12(spark, sf):
    kls = {k: S.approx_kl(F.col("logprob"), F.col("base_logprob"), k) for k in ("k1", "k2", "k3")}
    return view(spark, sf, "v_tokens").select("seq_id", "t", *[r6(c, 9).alias(k) for k, c in kls.items()])


_X = "CAST(embedding AS DOUBLE[])"
_LSE = "ln(list_sum(list_transform({}, lambda v: exp(v))))"


@query("f13_token_logprob", f"""SELECT vec_id, {q6(f"x[1 + label] / 2e0 - {_LSE.format('list_transform(x, lambda v: v / 2e0)')}")} AS logprob
FROM (SELECT vec_id, label, {_X} AS x FROM embeddings)""")
def f13(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(S.token_logprob(F.col("embedding"), F.col("label"), 2.0)).alias("logprob"))


@query("f14_entropy", f"""SELECT vec_id, {q6('z - list_sum(list_transform(x, lambda v: exp(v - z) * v))')} AS entropy
FROM (SELECT vec_id, x, {_LSE.format('x')} AS z FROM (SELECT vec_id, {_X} AS x FROM embeddings))""")
def f14(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(S.entropy(F.col("embedding"))).alias("entropy"))


_LAST = "COALESCE(max(CASE WHEN action_mask = 1 THEN t END) OVER (PARTITION BY seq_id), 3)"
_SEQ_REWARD = "max(CASE WHEN t = 0 THEN reward * 1e1 END) OVER (PARTITION BY seq_id)"


@query("f15_per_token_reward", f"""SELECT seq_id, t, {q6(f'(CASE WHEN t = last THEN greatest(least(sr, 2e0), -2e0) ELSE 0e0 END) - 0.1e0 * {_clamp(_D)}')} AS token_reward
FROM (SELECT *, {_LAST} AS last, {_SEQ_REWARD} AS sr FROM v_tokens)""", "v_tokens")
def f15(spark, sf):
    kl = S.approx_kl_tokens(F.col("logprobs"), F.col("base_logprobs"))
    reward = F.get("rewards", F.lit(0)) * 10.0
    rows = rollouts(spark, sf).withColumn(
        "token_reward", S.per_token_reward(reward, kl, F.col("action_mask"), 0.1, (-2.0, 2.0))
    )
    return _long(rows, "token_reward")


@query("f16_overlong_penalty", f"""SELECT o_orderkey, {q6('CASE WHEN e > 0 THEN -e / 512e0 * 0.5e0 ELSE 0e0 END')} AS penalty
FROM (SELECT o_orderkey, least(1 + o_custkey % 2048 - 1536, 512) AS e FROM orders)""")
def f16(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "1 + o_custkey % 2048 AS n")
    return rows.select("o_orderkey", r6(S.overlong_penalty(F.col("n"), 2048, 512, 0.5)).alias("penalty"))


@query("f17_normalize_reward", f"SELECT position, {q6('(reward - 12.5e0) / 3e0')} AS reward FROM v_responses", "v_responses")
def f17(spark, sf):
    return view(spark, sf, "v_responses").select("position", r6(R.normalize_reward(F.col("reward"), 12.5, 3.0)).alias("reward"))


def _group(spark, sf, shape):
    return shape(view(spark, sf, "v_responses")).select("position", r6("advantage").alias("advantage"))


_W = "OVER (PARTITION BY prompt_id)"


@query("w01_advantage_rloo", f"SELECT position, {q6(f'reward - (sum(reward) {_W} - reward) / (count(*) {_W} - 1)')} AS advantage FROM v_responses", "v_responses")
def w01(spark, sf):
    return _group(spark, sf, W.advantage_rloo)


@query("w02_advantage_mean_baseline", f"SELECT position, {q6(f'reward - avg(reward) {_W}')} AS advantage FROM v_responses", "v_responses")
def w02(spark, sf):
    return _group(spark, sf, W.advantage_mean_baseline)


@query("w03_advantage_group_norm", f"SELECT position, {q6(f'(reward - avg(reward) {_W}) / (stddev_samp(reward) {_W} + 1e-9)')} AS advantage FROM v_responses", "v_responses")
def w03(spark, sf):
    return _group(spark, sf, W.advantage_group_norm)


_MASKED = "SELECT seq_id, t, reward * action_mask AS r, value * action_mask AS v, action_mask AS m FROM v_tokens"


@query("w04_gae", f"""
WITH k AS ({_MASKED}), d AS (SELECT *, r + 0.99e0 * COALESCE(lead(v) OVER (PARTITION BY seq_id ORDER BY t), 0) - v AS delta FROM k),
a AS (SELECT x.seq_id, x.t, x.v, sum(power(0.99e0 * 0.9537128461e0, y.t - x.t) * y.delta) AS adv FROM d x JOIN d y ON y.seq_id = x.seq_id AND y.t >= x.t GROUP BY 1, 2, 3)
SELECT seq_id, t, {q6('adv')} AS advantages, {q6('adv + v')} AS returns FROM a""", "v_tokens")
def w04(spark, sf):
    adv, ret = W.gae(F.col("values"), F.col("rewards"), F.col("action_mask"), 0.99, 0.9537128461)
    return _long(rollouts(spark, sf).withColumns({"advantages": adv, "returns": ret}), "advantages", "returns")


@query("w05_discounted_returns", f"""
WITH k AS ({_MASKED})
SELECT x.seq_id, x.t, {q6('sum(power(0.9e0, y.t - x.t) * y.r)', 9)} AS returns FROM k x JOIN k y ON y.seq_id = x.seq_id AND y.t >= x.t GROUP BY 1, 2""", "v_tokens")
def w05(spark, sf):
    rows = rollouts(spark, sf)
    return _long(rows.withColumn("returns", W.discounted_returns(F.col("rewards"), F.col("action_mask"), 0.9)), "returns", digits=9)


@query("w05_token_returns_long", f"""SELECT seq_id, t, {q6('sum(r) OVER (PARTITION BY seq_id ORDER BY t DESC)')} AS returns FROM ({_MASKED})""", "v_tokens")
def w05b(spark, sf):
    out = W.token_returns_long(view(spark, sf, "v_tokens"))
    return out.select("seq_id", "t", r6("ret").alias("returns"))


def _samples(spark, sf):
    rows = rollouts(spark, sf)
    return rows.select(
        "seq_id", F.expr("seq_id - seq_id % 32").alias("prompt_id"), (F.get("rewards", F.lit(0)) * 10.0).alias("reward"),
        "values", "action_mask", F.expr("1000 + seq_id % 1000").alias("response_length"),
        S.approx_kl_tokens(F.col("logprobs"), F.col("base_logprobs")).alias("kl"),
    )


_OVER = "least(1000 + seq_id % 1000 - 1500, 500)"
_TOKEN_REWARDS = f"""
s AS (SELECT seq_id, max(CASE WHEN t = 0 THEN reward * 1e1 END) + CASE WHEN {_OVER} > 0 THEN -{_OVER} / 500e0 ELSE 0e0 END AS sr,
  COALESCE(max(CASE WHEN action_mask = 1 THEN t END), 3) AS last FROM v_tokens GROUP BY seq_id),
g AS (SELECT *, seq_id - seq_id % 32 AS prompt_id FROM s),
h AS (SELECT *, {{shape}} AS shaped FROM g WINDOW w AS (PARTITION BY prompt_id)),
k AS (SELECT v.seq_id, t, action_mask AS m, value * action_mask AS v, (CASE WHEN t = last THEN shaped ELSE 0e0 END) - 0.05e0 * {_clamp(_D)} AS tr
  FROM v_tokens v JOIN h ON h.seq_id = v.seq_id)"""


@query("w06_compute_advantages", "WITH " + _TOKEN_REWARDS.format(shape="(sr - avg(sr) OVER w) / (stddev_samp(sr) OVER w + 1e-9)") + f"""
SELECT x.seq_id, x.t, {q6('sum(y.tr * y.m)')} AS advantages, {q6('max(z.total)')} AS total FROM k x JOIN k y ON y.seq_id = x.seq_id AND y.t >= x.t
JOIN (SELECT seq_id, sum(tr) AS total FROM k GROUP BY 1) z ON z.seq_id = x.seq_id GROUP BY 1, 2""", "v_tokens")
def w06(spark, sf):
    out = W.compute_advantages(_samples(spark, sf), "group_norm", kl_coef=0.05, overlong=(2000, 500, 1.0))
    return _long(out.withColumn("total", F.transform("advantages", lambda _: F.col("return"))), "advantages", "total")


@query("w06_compute_advantages_gae", "WITH " + _TOKEN_REWARDS.format(shape="sr") + f""",
d AS (SELECT *, tr * m + COALESCE(lead(v) OVER (PARTITION BY seq_id ORDER BY t), 0) - v AS delta FROM k),
a AS (SELECT x.seq_id, x.t, x.v, sum(power(0.9537128461e0, y.t - x.t) * y.delta) AS adv FROM d x JOIN d y ON y.seq_id = x.seq_id AND y.t >= x.t GROUP BY 1, 2, 3)
SELECT seq_id, t, {q6('adv')} AS advantages, {q6('adv + v')} AS returns FROM a""", "v_tokens")
def w06b(spark, sf):
    out = W.compute_advantages(_samples(spark, sf), "gae", lam=0.9537128461, kl_coef=0.05, overlong=(2000, 500, 1.0))
    return _long(out, "advantages", "returns")


@query("w07_normalize_advantages_global", f"""
WITH x AS (SELECT seq_id, t, action_mask AS m, sum(reward * action_mask) OVER (PARTITION BY seq_id ORDER BY t DESC) AS a FROM v_tokens),
z AS (SELECT avg(a) AS mu, greatest(var_pop(a), 1e-8) AS v FROM x WHERE m = 1)
SELECT seq_id, t, {q6('(a - (SELECT mu FROM z)) / sqrt((SELECT v FROM z))')} AS advantages FROM x""", "v_tokens")
def w07(spark, sf):
    rows = rollouts(spark, sf).withColumn("advantages", W.discounted_returns(F.col("rewards"), F.col("action_mask")))
    return _long(W.normalize_advantages_global(rows), "advantages")


_FACTOR = "1 + greatest(least(kl / 2e0 - 1, 0.2e0), -0.2e0) * 64 / 10000e0"
_RUNS = "SELECT user_id % 7 AS run_id, event_id AS step, value / 1e1 AS kl, 64 AS n_steps FROM {events}"


@query("w08_adaptive_kl", f"""SELECT run_id, step, {q6(f'0.1e0 * exp(sum(ln({_FACTOR})) OVER (PARTITION BY run_id ORDER BY step))')} AS kl_coef
FROM ({_RUNS.format(events='events')})""")
def w08(spark, sf):
    out = W.adaptive_kl(run_sql(spark, sf, _RUNS), 0.1, 2.0, 10000.0)
    return out.select("run_id", "step", r6("kl_coef").alias("kl_coef"))


# ---------------------------------------------------------------------------------------------
# objective metrics

_H = "((policy_chosen_logprob - policy_rejected_logprob) - (ref_chosen_logprob - ref_rejected_logprob))"


def _nls(x: str) -> str:
    """-ln σ(x) in SQL, stable."""
    return f"(greatest(0e0, -({x})) + ln(1 + exp(-abs({x}))))"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


@query("l01_dpo_loss", f"SELECT pair_id, {q6('0.9e0 * ' + _nls('0.1e0 * ' + _H) + ' + 0.1e0 * ' + _nls('-0.1e0 * ' + _H))} AS loss FROM v_margins", "v_margins")
def l01(spark, sf):
    return O.dpo_loss(view(spark, sf, "v_margins"), 0.1, 0.1).select("pair_id", r6("loss").alias("loss"))


@query("l01_dpo_loss_mean", f"SELECT {q6('avg(' + _nls('0.1e0 * ' + _H) + ')')} AS loss FROM v_margins", "v_margins")
def l01b(spark, sf):
    return O.mean_loss(O.dpo_loss(view(spark, sf, "v_margins"), 0.1)).select(r6("loss").alias("loss"))


@query("l02_ipo_loss", f"SELECT pair_id, {q6(f'({_H} - 5) * ({_H} - 5)')} AS loss FROM v_margins", "v_margins")
def l02(spark, sf):
    return O.ipo_loss(view(spark, sf, "v_margins"), 0.1).select("pair_id", r6("loss").alias("loss"))


@query("l03_pairwise_loss", f"SELECT {q6('avg(' + _nls('chosen_reward - rejected_reward') + ')')} AS loss, "
       f"{q6('avg(' + _nls('chosen_reward - rejected_reward - 0.5e0') + ')')} AS margin_loss FROM ({_REWARDS_SQL})", "v_margins")
def l03(spark, sf):
    c, r = F.col("chosen_reward"), F.col("rejected_reward")
    return run_sql(spark, sf, _REWARDS).agg(
        r6(F.avg(L.pairwise(c, r))).alias("loss"), r6(F.avg(L.pairwise(c, r, F.lit(0.5)))).alias("margin_loss")
    )


@query("l04_logexp_loss", f"SELECT {q6('avg(' + _nls('chosen_reward - rejected_reward') + ')')} AS loss FROM ({_REWARDS_SQL})", "v_margins")
def l04(spark, sf):
    rows = run_sql(spark, sf, _REWARDS)
    return rows.agg(r6(F.avg(L.log_exp(F.col("chosen_reward"), F.col("rejected_reward")))).alias("loss"))


@query("l05_kto_loss", f"""
WITH z AS (SELECT greatest(avg(policy_kl_logp - ref_kl_logp), 0e0) AS kl FROM v_kto)
SELECT {q6(f"avg(CASE WHEN label = 1 THEN 1.5e0 * (1 - {_sig('0.5e0 * (policy_logp - ref_logp - (SELECT kl FROM z))')}) ELSE 1 - {_sig('0.5e0 * ((SELECT kl FROM z) - policy_logp + ref_logp)')} END)")} AS loss,
{q6('(SELECT kl FROM z)')} AS kl FROM v_kto""", "v_kto")
def l05(spark, sf):
    rows = view(spark, sf, "v_kto")
    out = O.kto_loss(rows, 0.5, 1.5, 1.0, kl=F.col("policy_kl_logp") - F.col("ref_kl_logp"))
    return out.select(r6("loss").alias("loss"), r6("kl").alias("kl"))


@query("l06_kto_even_loss", f"""
WITH z AS (SELECT greatest(avg(policy_chosen_logprob - ref_chosen_logprob), 0e0) AS c, greatest(avg(policy_rejected_logprob - ref_rejected_logprob), 0e0) AS r FROM v_margins)
SELECT {q6('avg(loss)')} AS loss FROM (
  SELECT 1 - {_sig('0.1e0 * (policy_chosen_logprob - ref_chosen_logprob - (SELECT r FROM z))')} AS loss FROM v_margins
  UNION ALL SELECT 1 - {_sig('0.1e0 * ((SELECT c FROM z) - policy_rejected_logprob + ref_rejected_logprob)')} FROM v_margins)""", "v_margins")
def l06(spark, sf):
    return O.kto_even_loss(view(spark, sf, "v_margins"), 0.1).select(r6("loss").alias("loss"))


def _policy_rows(spark, sf):
    return rollouts(spark, sf).select(
        "seq_id", "action_mask", "logprobs", "values",
        F.transform("logprobs", lambda x: x * 0.9 + 0.02).alias("old_logprobs"),
        F.transform("logprobs", lambda x: x * 0.8).alias("rollout_logprobs"),
        F.transform("rewards", lambda x: x - 0.2).alias("advantages"),
    )


_POLICY = """p AS (SELECT seq_id, t, action_mask AS m, logprob AS lp, logprob * 0.9e0 + 0.02e0 AS old, logprob * 0.8e0 AS ro, reward - 0.2e0 AS adv FROM v_tokens),
s AS (SELECT *, exp(lp - old) * adv AS s1, greatest(least(exp(lp - old), 1.2e0), 0.8e0) * adv AS s2 FROM p)"""


@query("l07_ppo_clip_metrics", f"""WITH {_POLICY}
SELECT {q6('sum(-least(s1, s2) * m) / sum(m)')} AS loss, {q6('sum(CASE WHEN s2 < s1 THEN m ELSE 0 END) / CAST(sum(m) AS DOUBLE)')} AS clip_ratio, {q6('sum((old - lp) * m) / sum(m)')} AS ppo_kl FROM s""", "v_tokens")
def l07(spark, sf):
    out = O.ppo_metrics(_policy_rows(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("l07_ppo_dual_clip_sequence", f"""WITH {_POLICY}
SELECT {q6('avg(x)')} AS loss FROM (SELECT seq_id, sum(-(CASE WHEN adv < 0 THEN greatest(least(s1, s2), 3e0 * adv) ELSE least(s1, s2) END) * m) / nullif(sum(m), 0) AS x FROM s GROUP BY 1)""", "v_tokens")
def l07b(spark, sf):
    return O.ppo_metrics(_policy_rows(spark, sf), dual_clip=3.0, token_level=False).select(r6("loss").alias("loss"))


@query("l08_gspo_ratio", f"""WITH {_POLICY},
q AS (SELECT *, exp(sum((lp - old) * m) OVER w / nullif(sum(m) OVER w, 0)) * m AS r FROM p WINDOW w AS (PARTITION BY seq_id)),
u AS (SELECT *, r * adv AS s1, greatest(least(r, 1.0004e0), 0.9997e0) * adv AS s2 FROM q)
SELECT {q6('avg(x)')} AS loss, {q6('sum(c) / CAST(sum(n) AS DOUBLE)')} AS clip_ratio FROM (SELECT seq_id, sum(-least(s1, s2) * m) / nullif(sum(m), 0) AS x, sum(CASE WHEN s2 < s1 THEN m ELSE 0 END) AS c, sum(m) AS n FROM u GROUP BY 1)""", "v_tokens")
def l08(spark, sf):
    out = O.ppo_metrics(_policy_rows(spark, sf), low=3e-4, high=4e-4, kind="gspo")
    return out.select(r6("loss").alias("loss"), r6("clip_ratio").alias("clip_ratio"))


@query("l09_truncated_is_correction", f"""WITH {_POLICY}
SELECT {q6('sum(least(exp(old - ro), 0.95e0) * -least(s1, s2) * m) / sum(m)')} AS loss, {q6('sum((ro - old) * m) / sum(m)')} AS rollout_kl FROM s""", "v_tokens")
def l09(spark, sf):
    return O.ppo_metrics(_policy_rows(spark, sf), weight_cap=0.95).select(r6("loss").alias("loss"), r6("rollout_kl").alias("rollout_kl"))


_VALUES = "v AS (SELECT seq_id, action_mask AS m, value AS v, 0.5e0 AS o, reward AS r FROM v_tokens)"


@query("l10_value_loss", f"""WITH {_VALUES}
SELECT {q6('0.5e0 * sum(m * greatest((v - r) * (v - r), (o + greatest(least(v - o, 0.2e0), -0.2e0) - r) * (o + greatest(least(v - o, 0.2e0), -0.2e0) - r))) / sum(m)')} AS loss,
{q6('0.5e0 * sum(m * (v - r) * (v - r)) / sum(m)')} AS plain FROM v""", "v_tokens")
def l10(spark, sf):
    rows = rollouts(spark, sf).withColumnRenamed("rewards", "returns").withColumn("old_values", F.transform("values", lambda _: F.lit(0.5)))
    both = O.value_loss(rows, 0.2).withColumn("kind", F.lit(1)).unionByName(O.value_loss(rows).withColumn("kind", F.lit(2)))
    return both.agg(
        r6(F.max(F.when(F.col("kind") == 1, F.col("loss")))).alias("loss"), r6(F.max(F.when(F.col("kind") == 2, F.col("loss")))).alias("plain")
    )


@query("l11_sft_loss", f"""SELECT {q6('(SELECT sum(-logprob * action_mask) / sum(action_mask) FROM v_tokens)')} AS token_loss, {q6('avg(x)')} AS sequence_loss
FROM (SELECT sum(-logprob * action_mask) / nullif(sum(action_mask), 0) AS x FROM v_tokens GROUP BY seq_id)""", "v_tokens")
def l11(spark, sf):
    rows = rollouts(spark, sf)
    tokens, rows_mean = [O.sft_loss(rows, level, mask="action_mask") for level in (True, False)]
    both = tokens.withColumn("kind", F.lit(1)).unionByName(rows_mean.withColumn("kind", F.lit(2)))
    return both.agg(
        r6(F.max(F.when(F.col("kind") == 1, F.col("loss")))).alias("token_loss"),
        r6(F.max(F.when(F.col("kind") == 2, F.col("loss")))).alias("sequence_loss"),
    )


_LABEL = "CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END"
_LOGITS = f"SELECT vec_id, {_LABEL} AS label, {_X} AS x, list_reverse({_X}) AS y FROM embeddings"


def _logits(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", F.expr(_LABEL).alias("label"), F.col("embedding").alias("logits"), F.reverse("embedding").alias("teacher_logits"))


_CE = f"avg(CASE WHEN label <> -100 THEN {_LSE.format('x')} - x[1 + label] END)"


@query("l12_lm_loss", f"SELECT {q6(_CE)} AS loss FROM ({_LOGITS})")
def l12(spark, sf):
    return O.lm_loss(_logits(spark, sf)).select(r6("loss").alias("loss"))


_KD = f"avg(CASE WHEN label <> -100 THEN -list_sum(list_transform(list_zip(x, y), lambda p: exp(p[2] - zy) * (p[1] - zx))) END)"


@query("l13_distillation_loss", f"""SELECT {q6(_KD)} AS distil_loss, {q6(_CE)} AS lm_loss, {q6(f'0.6e0 * {_CE} + 0.4e0 * {_KD}')} AS loss
FROM (SELECT *, {_LSE.format('x')} AS zx, {_LSE.format('y')} AS zy FROM ({_LOGITS}))""")
def l13(spark, sf):
    out = O.distillation_loss(_logits(spark, sf), 0.4)
    return out.select(*[r6(c).alias(c) for c in out.columns])


# two classes: the sums of either half of a vector
_TWO = f"""SELECT a, b, ln(exp(a) + exp(b)) AS z, vec_id FROM (
  SELECT vec_id, list_sum(x[1:len(x) // 2]) AS a, list_sum(x[len(x) // 2 + 1:]) AS b FROM (SELECT vec_id, {_X} AS x FROM embeddings)) WHERE vec_id % 5 <> 0"""


@query("l14_process_reward_loss", f"""
SELECT 'hard' AS kind, {q6('avg(z - CASE WHEN vec_id % 2 = 0 THEN a ELSE b END)')} AS loss, {q6('avg(CASE WHEN (a >= b) = (vec_id % 2 = 0) THEN 1e0 ELSE 0e0 END)')} AS acc FROM ({_TWO})
UNION ALL SELECT 'soft', {q6('avg(p * (z - a) + (1 - p) * (z - b))')}, {q6('avg(CASE WHEN (a >= b) = (p >= 0.5) THEN 1e0 ELSE 0e0 END)')} FROM (SELECT *, (vec_id % 10) / 1e1 AS p FROM ({_TWO}))""")
def l14(spark, sf):
    x, half = A.as_double(F.col("embedding")), F.floor(F.size("embedding") / 2).cast("int")
    halves = F.array(A.array_sum(A.cut(x, half)), A.array_sum(F.slice(x, half + 1, F.size(x) - half)))
    rows = table(spark, sf, "embeddings").select("vec_id", halves.alias("logits"))
    hard = rows.withColumn("label", F.expr("CASE WHEN vec_id % 5 = 0 THEN -100 ELSE vec_id % 2 END"))
    soft = rows.withColumn("label", F.expr("CASE WHEN vec_id % 5 = 0 THEN -100e0 ELSE (vec_id % 10) / 1e1 END"))
    both = O.process_reward_loss(hard, False).withColumn("kind", F.lit("hard"))
    both = both.unionByName(O.process_reward_loss(soft, True).withColumn("kind", F.lit("soft")))
    return both.select("kind", r6("loss").alias("loss"), r6("acc").alias("acc"))


@query("l15_combined_objective", f"""SELECT {q6('avg(l)')} AS preference_loss, {q6('avg(n)')} AS nll_loss, {q6('avg(l) + 0.2e0 * avg(n)')} AS loss
FROM (SELECT {_nls('0.1e0 * ' + _H)} AS l, -policy_chosen_logprob / chosen_len AS n FROM v_margins)""", "v_margins")
def l15(spark, sf):
    rows = view(spark, sf, "v_margins").withColumn("nll", -F.col("policy_chosen_logprob") / F.col("chosen_len"))
    out = O.combined_objective(rows, 0.1, 0.2, "nll")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("u04_chosen_rejected_stack", """SELECT pair_id, 0 AS side, chosen AS response, chosen_len AS n FROM v_margins
UNION ALL SELECT pair_id, 1, rejected, rejected_len FROM v_margins""", "v_margins")
def u04(spark, sf):
    pairs = {"response": ("chosen", "rejected"), "n": ("chosen_len", "rejected_len")}
    return chosen_rejected_stack(view(spark, sf, "v_margins"), pairs, keep=["pair_id"])
