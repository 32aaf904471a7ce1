"""Rollout arithmetic: group baselines, token rewards, returns and advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions import scores as S
from prefspark.functions.scalars import clip, safe_div
from prefspark.operators.groups import with_group_stats
from prefspark.operators.positions import running_sums

GROUP_ESTIMATORS = ("rloo", "reinforce_baseline", "dr_grpo", "group_norm")
ESTIMATORS = ("gae", "reinforce", *GROUP_ESTIMATORS)
NORMALIZED = ("gae", "reinforce", "reinforce_baseline")


def advantage_rloo(df: DataFrame, group: str = "prompt_id", reward: str = "reward", name: str = "advantage") -> DataFrame:
    """Reward minus the mean of the other samples of its group."""
    stats = {"_sum": F.sum(reward), "_n": F.count(F.lit(1))}
    others = safe_div(F.col("_sum") - F.col(reward), F.col("_n") - 1)
    return with_group_stats(df, [group], stats).withColumn(name, F.col(reward) - others).drop(*stats)


def advantage_mean_baseline(
    df: DataFrame, group: str = "prompt_id", reward: str = "reward", name: str = "advantage"
) -> DataFrame:
    """Reward minus the mean of its group."""
    out = with_group_stats(df, [group], {"_mean": F.avg(reward)})
    return out.withColumn(name, F.col(reward) - F.col("_mean")).drop("_mean")


def advantage_group_norm(
    df: DataFrame, group: str = "prompt_id", reward: str = "reward", name: str = "advantage"
) -> DataFrame:
    """Reward standardised within its group."""
    stats = {"_mean": F.avg(reward), "_std": F.stddev_samp(reward)}
    shaped = (F.col(reward) - F.col("_mean")) / (F.col("_std") + 1e-9)
    return with_group_stats(df, [group], stats).withColumn(name, shaped).drop(*stats)


def gae(values: Column, rewards: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0) -> tuple[Column, Column]:
    """Advantages and returns of token arrays; values and rewards are masked first."""
    m = A.as_double(mask)
    v, r = A.mul(m, values), A.mul(m, rewards)
    ahead = F.zip_with(r, A.shift_left(v, 0.0), lambda x, nxt: x + gamma * nxt)
    advantages = A.discounted_suffix(A.sub(ahead, v), gamma * lam)
    return advantages, F.zip_with(advantages, v, lambda a, x: a + x)


def discounted_returns(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Discounted sum of the masked rewards from each token on."""
    return A.discounted_suffix(A.mul(A.as_double(mask), rewards), gamma)


def token_returns_long(df: DataFrame, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Undiscounted returns of a one-row-per-token table, for sequences of any length."""
    masked = F.col("reward") * F.col("action_mask")
    return running_sums(df, [F.col(t).desc()], {"ret": masked}, groups=[seq])


def compute_advantages(
    df: DataFrame,
    estimator: str,
    gamma: float = 1.0,
    lam: float = 1.0,
    kl_coef: float = 0.0,
    clip_range: tuple[float, float] | None = None,
    overlong: tuple[int, int, float] | None = None,
    group: str = "prompt_id",
) -> DataFrame:
    """Token advantages and returns of rollout rows.

    Needs ``reward``, ``kl``, ``action_mask`` and, for ``gae``, ``values``; ``overlong`` is
    (max_len, buffer, factor) over ``response_length``. Group estimators fix gamma at one.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown advantage estimator {estimator!r}; valid: {list(ESTIMATORS)}")
    out = df
    if overlong:
        out = out.withColumn("reward", F.col("reward") + S.overlong_penalty(F.col("response_length"), *overlong))
    out = out.withColumn("_shaped", F.col("reward"))
    if estimator in GROUP_ESTIMATORS:
        gamma = 1.0
        shape = {"rloo": advantage_rloo, "group_norm": advantage_group_norm}.get(estimator, advantage_mean_baseline)
        out = shape(out, group, "reward", "_shaped")
    token = S.per_token_reward(F.col("_shaped"), F.col("kl"), F.col("action_mask"), kl_coef, clip_range)
    out = out.withColumn("token_reward", token)
    if estimator == "gae":
        adv, ret = gae(F.col("values"), F.col("token_reward"), F.col("action_mask"), gamma, lam)
        out = out.withColumn("advantages", adv)
        out = out.withColumn(
            "returns",
            F.zip_with(
                "advantages", A.mul(A.as_double(F.col("action_mask")), F.col("values")), lambda a, v: a + v
            ),
        )
    else:
        out = out.withColumn("returns", discounted_returns(F.col("token_reward"), F.col("action_mask"), gamma))
        out = out.withColumn("advantages", F.col("returns"))
    return out.withColumn("return", A.array_sum(F.col("token_reward"))).drop("_shaped")


def normalize_advantages_global(
    df: DataFrame, advantages: str = "advantages", mask: str = "action_mask", scale: bool = True
) -> DataFrame:
    """Standardise all token advantages by the mean and population variance of the action tokens.

    One pass over the tokens gives both; the result enters the rows as a scalar subquery.
    """
    tokens = df.select(F.explode(F.arrays_zip(F.col(advantages).alias("a"), F.col(mask).alias("m"))).alias("x"))
    action = tokens.where(F.col("x.m") == 1)
    stats = action.agg(F.struct(F.avg("x.a").alias("mean"), F.var_pop("x.a").alias("var"))).scalar()
    factor = F.lit(1.0) / F.sqrt(F.greatest(stats["var"], F.lit(1e-8))) if scale else F.lit(1.0)
    scaled = df.withColumns({"_mean": stats["mean"], "_factor": factor})
    return scaled.withColumn(
        advantages, F.transform(advantages, lambda a: (a - F.col("_mean")) * F.col("_factor"))
    ).drop("_mean", "_factor")


def adaptive_kl(
    df: DataFrame, init: float, target: float, horizon: float, run: str = "run_id", step: str = "step",
    kl: str = "kl", n_steps: str = "n_steps",
) -> DataFrame:
    """KL coefficient after each step: the running product of the clipped proportional updates.

    The product is a running sum of logarithms with the signs and zeros counted apart.
    """
    error = clip(F.col(kl) / target - 1, -0.2, 0.2)
    factor = 1 + error * F.col(n_steps) / horizon
    sums = {
        "_log": F.when(factor == 0, F.lit(0.0)).otherwise(F.ln(F.abs(factor))),
        "_negative": (factor < 0).cast("long"),
        "_zero": (factor == 0).cast("long"),
    }
    out = running_sums(df, [step], sums, groups=[run])
    sign = F.when(F.pmod("_negative", F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    value = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(init * sign * F.exp("_log"))
    return out.withColumn("kl_coef", value).drop(*sums)


def fixed_kl(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("kl_coef", F.lit(value))
