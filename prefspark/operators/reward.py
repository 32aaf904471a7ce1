"""Scored responses: post-processors, reward statistics and evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions.scalars import safe_div
from prefspark.operators.groups import with_group_stats
from prefspark.operators.joins import attach_datasource
from prefspark.schema import require_columns

DEFAULT_REWARD_TEMPLATE = "{input} <rm_score>: {reward} "  # fixed value


def _first_at(values, key: Column, position: str, greatest: bool) -> Column:
    """Aggregate: ``values`` of the extreme ``key``, the earliest position on ties."""
    if greatest:
        return F.max_by(F.struct(*values), F.struct(key, -F.col(position)))
    return F.min_by(F.struct(*values), F.struct(key, F.col(position)))


def best_of_n(df: DataFrame, position: str = "position") -> DataFrame:
    """Per input the response of the greatest reward; the first one wins ties."""
    best = _first_at(["output", "reward"], F.col("reward"), position, True)
    return df.groupBy("input").agg(best.alias("_b")).select("input", "_b.output", "_b.reward")


def iterative_pairs(df: DataFrame, position: str = "position") -> DataFrame:
    """Per input the first best response as chosen and the first worst as rejected."""
    return (
        df.groupBy(F.col("input").alias("prompt"))
        .agg(
            _first_at(["output", "reward"], F.col("reward"), position, True).alias("_c"),
            _first_at(["output", "reward"], F.col("reward"), position, False).alias("_r"),
        )
        .select(
            "prompt",
            F.col("_c.output").alias("chosen"),
            F.col("_c.reward").alias("chosen_reward"),
            F.col("_r.output").alias("rejected"),
            F.col("_r.reward").alias("rejected_reward"),
        )
    )


def reward_summary(df: DataFrame, reward: str = "reward") -> DataFrame:
    """Global mean and sample deviation; NULL deviation for one row."""
    return df.agg(F.avg(reward).alias("reward_mean"), F.stddev_samp(reward).alias("reward_std"))


def normalize_rewards_global(df: DataFrame, reward: str = "reward") -> DataFrame:
    """Standardise by the global mean and sample deviation (a scalar subquery, not a join)."""
    stats = df.agg(F.struct(F.avg(reward).alias("mean"), F.stddev_samp(reward).alias("std"))).scalar()
    return df.withColumn(reward, safe_div(F.col(reward) - stats["mean"], stats["std"]))


def normalize_reward(reward: Column, mean, std) -> Column:
    """Standardise by stored statistics."""
    return safe_div(reward - mean, std)


def conditional_sft(df: DataFrame, template: str | None = None, normalize: bool = False) -> DataFrame:
    """Write the reward, with two decimals, into the prompt."""
    template = template or DEFAULT_REWARD_TEMPLATE
    if "{input}" not in template or "{reward}" not in template:
        raise ValueError("the reward template needs {input} and {reward}")
    out = normalize_rewards_global(df) if normalize else df
    shown = F.replace(F.lit(template), F.lit("{reward}"), F.call_function("format_number", F.col("reward"), F.lit("0.00")))
    return out.withColumn("input", F.replace(shown, F.lit("{input}"), F.col("input")))


PROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "rs": best_of_n,
    "csft": conditional_sft,
    "iter_dpo": iterative_pairs,
}


def get_processor(name: str) -> Callable[..., DataFrame]:
    if name not in PROCESSORS:
        raise ValueError(f"unknown post-processor {name!r}; valid: {sorted(PROCESSORS)}")
    return PROCESSORS[name]


def reward_model_stats(df: DataFrame, chosen: str = "chosen_reward", rejected: str = "rejected_reward") -> DataFrame:
    """Mean and floored deviation over both rewards of every pair."""
    both = df.select(F.explode(F.array(chosen, rejected)).alias("r"))
    return both.agg(F.avg("r").alias("mean"), F.greatest(F.stddev_samp("r"), F.lit(1e-8)).alias("std"))


def reward_histogram(df: DataFrame, reward: str, low: float = -10.0, high: float = 10.0, bins: int = 10) -> DataFrame:
    """Fraction of the in-range rewards per equal bin; the last bin includes its right edge."""
    inside = df.where(F.col(reward).between(low, high))
    bucket = F.least(F.width_bucket(F.col(reward), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = inside.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = inside.agg(F.count(F.lit(1))).scalar()
    return counts.select("bin", "n", (F.col("n") / total).alias("fraction"))


def preference_accuracy(df: DataFrame, chosen: str, rejected: str, batch: str | None = None) -> DataFrame:
    """Share of pairs whose chosen reward is strictly greater; optionally a mean of batch means."""
    hit = (F.col(chosen) > F.col(rejected)).cast("double")
    if batch is None:
        return df.agg(F.avg(hit).alias("acc"))
    return df.groupBy(batch).agg(F.avg(hit).alias("_acc")).agg(F.avg("_acc").alias("acc"))


def pass_at_k(samples: DataFrame, prompts: DataFrame, n: int, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Per datasource the mean best reward of n samples, the mean reward and the number of prompts.

    Of a single sample both are the same: there is one column ``pass1``.
    """
    best = [] if n == 1 else [F.avg("_best").alias(f"pass{n}")]
    per_prompt = samples.groupBy(group).agg(
        F.max(reward).alias("_best"), F.avg(reward).alias("_mean"), F.first("prompt").alias("prompt")
    )
    return (
        attach_datasource(per_prompt, prompts)
        .groupBy("datasource")
        .agg(*best, F.avg("_mean").alias("pass1"), F.count(F.lit(1)).alias("count"))
    )


def group_reward_std(df: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    return with_group_stats(df, [group], {"group_reward_std": F.stddev_samp(reward)})


def mean_metrics(df: DataFrame, step: str = "step", info: str = "info") -> DataFrame:
    """Mean of every metric per step, then over the steps."""
    long = df.select(step, F.explode(info).alias("metric", "value"))
    per_step = long.groupBy(step, "metric").agg(F.avg("value").alias("_v"))
    return per_step.groupBy("metric").agg(F.avg("_v").alias("value"))


def length_weighted_kl(df: DataFrame, step: str = "step", kl: str = "kl", length: str = "response_length") -> DataFrame:
    weighted = F.sum(F.col(kl) * F.col(length))
    return df.groupBy(step).agg(safe_div(weighted, F.sum(length)).alias("kl"))


def reduce_metrics(df: DataFrame, op: str = "mean", key: str = "metric", value: str = "value") -> DataFrame:
    """Reduce every metric over the workers that reported it."""
    reducers = {"mean": F.avg, "max": F.max, "sum": F.sum}
    if op not in reducers:
        raise ValueError(f"unknown reduction {op!r}")
    return df.groupBy(key).agg(reducers[op](value).alias(value))


REWARD_RESULT = T.StructType(
    [
        T.StructField("rewards", T.DoubleType()),
        T.StructField("scores", T.DoubleType()),
        T.StructField("extra_logs", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def apply_reward_func(df: DataFrame, reward_func: Callable, key: str = "sample_id", chunk: int = 8) -> DataFrame:
    """Run a user reward function on chunks of (queries, prompts, labels).

    It returns ``{"rewards": [...], "scores": [...]?, "extra_logs": {name: [...]}?}``. Rows stream
    through in Arrow batches; the function is called with at most ``chunk`` rows.
    """
    require_columns(df, key, "query", "prompt", "label")
    schema = T.StructType([df.schema[key], *REWARD_RESULT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[c].tolist() for c in ("query", "prompt", "label")]
            rewards, scores, logs = [], [], []
            for start in range(0, len(batch), chunk):
                part = [c[start : start + chunk] for c in columns]
                got = reward_func(*part)
                rewards.extend(map(float, got["rewards"]))
                scores.extend(map(float, got.get("scores", got["rewards"])))
                extra = got.get("extra_logs") or {}
                logs.extend({k: float(v[i]) for k, v in extra.items()} for i in range(len(part[0])))
            yield pd.DataFrame({key: batch[key], "rewards": rewards, "scores": scores, "extra_logs": logs})

    return df.select(key, "query", "prompt", "label").mapInPandas(run, schema)


LOGPROB_NAMES = [f"{m}_{s}_logprob" for m in ("policy", "ref") for s in ("chosen", "rejected")]


def score_pairs(df: DataFrame, make_scorer: Callable[[], Callable], key: str = "pair_id") -> DataFrame:
    """Run a model scorer over pairs; it is built once per partition and fed Arrow batches.

    ``make_scorer()`` returns a function from (prompts, chosen, rejected) to four lists: policy and
    reference log-probs of chosen and rejected.
    """
    kept = [df.schema[c] for c in (key, "prompt", "chosen", "rejected")]
    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in LOGPROB_NAMES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            columns = scorer(batch["prompt"].tolist(), batch["chosen"].tolist(), batch["rejected"].tolist())
            yield batch.assign(**dict(zip(LOGPROB_NAMES, columns)))

    return df.select(key, "prompt", "chosen", "rejected").mapInPandas(run, schema)


def length_scorer() -> Callable:
    """Deterministic stand-in for a model: log-probs fall with the answer's length."""

    def score(prompts, chosen, rejected):
        def side(texts, rate):
            return [-rate * len(t) for t in texts]

        return side(chosen, 0.5), side(rejected, 0.75), side(chosen, 0.625), side(rejected, 0.625)

    return score
