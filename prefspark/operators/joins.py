"""Left equi-joins that attach scores to pairs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prefspark.operators.groups import join_unique
from prefspark.schema import PAIR_KEY, first_present, nan_to_null, require_columns


def pair_key() -> Column:
    """Digest of the three texts joined by NUL.

    The score side then shuffles a fixed 64 characters per row instead of three whole texts.
    """
    return F.sha2(F.concat(*[p for n in PAIR_KEY for p in (F.col(n), F.lit("\0"))][:-1]), 256)


def _attach(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    clash = sorted(set(cols) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    keyed = right.select(pair_key().alias("_key"), *cols)
    return left.withColumn("_key", pair_key()).join(keyed, "_key", "left").drop("_key")


def ensure_im(df: DataFrame) -> DataFrame:
    """``im`` falls back to ``margin``."""
    if "im" in df.columns or "margin" not in df.columns:
        return df
    return df.withColumn("im", F.col("margin"))


def merge_im_rad(im: DataFrame, rad: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Attach the discrepancy and the inverse model's log-probs; pairs without a match keep NULL.

    ``counts`` observes ``unmatched`` and is exact when the join runs once; a global sort behind it
    samples its input in an extra run. :func:`unmatched_count` is the plain aggregate.
    """
    source = first_present(rad, "rad", "margin")
    right = nan_to_null(rad).withColumn("rad", F.col(source))
    cols = ["rad"]
    if "ref_chosen_logprob" in rad.columns:
        names = {f"ref_{s}_logprob": f"inv_{s}_logprob" for s in ("chosen", "rejected")}
        right = right.withColumnsRenamed(names)
        cols += names.values()
    out = _attach(ensure_im(nan_to_null(im)), right, cols)
    if counts is not None:
        out = out.observe(counts, F.count_if(F.col("rad").isNull()).alias("unmatched"))
    return out


def merge_em(df: DataFrame, em: DataFrame) -> DataFrame:
    """Attach every judge column; ``em_margin`` falls back to ``em``."""
    cols = [c for c in em.columns if c not in PAIR_KEY]
    out = _attach(df, nan_to_null(em), cols)
    if "em_margin" not in out.columns and "em" in out.columns:
        out = out.withColumn("em_margin", F.col("em"))
    return out


def unmatched_count(df: DataFrame, name: str = "rad") -> DataFrame:
    return df.agg(F.count_if(F.col(name).isNull()).alias("unmatched"))


def attach_rewards(samples: DataFrame, rewards: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rewards, scores (default: the rewards) and extra logs, on the sample and in its info map."""
    require_columns(rewards, key, "rewards")
    score = F.coalesce("scores", "rewards") if "scores" in rewards.columns else F.col("rewards")
    extra = [F.col("extra_logs")] if "extra_logs" in rewards.columns else []
    right = rewards.select(key, F.col("rewards").alias("reward"), score.alias("score"), *extra)
    out = samples.join(right, key, "left")
    logged = F.create_map(F.lit("score"), F.col("score"), F.lit("reward"), F.col("reward"))
    if extra:
        empty = F.create_map().cast("map<string,double>")
        logged = _overlay(logged, F.coalesce(F.col("extra_logs"), empty))
    if "info" in samples.columns:
        logged = _overlay(F.col("info"), logged)
    return out.withColumn("info", logged).drop("extra_logs")


def _overlay(base: Column, update: Column) -> Column:
    """Union of two maps in which ``update`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(update, k)), update)


def prompt_to_datasource(prompts: DataFrame, position: str = "position") -> DataFrame:
    """Datasource of every prompt text; the last occurrence wins."""
    return prompts.groupBy("prompt").agg(F.max_by("datasource", position).alias("datasource"))


def attach_datasource(samples: DataFrame, prompts: DataFrame, position: str = "position") -> DataFrame:
    return join_unique(samples, prompt_to_datasource(prompts, position), ["prompt"], "left")


def policy_reference_join(policy: DataFrame, reference: DataFrame, key: str = "pair_id") -> DataFrame:
    """Scores of the two models of the same pair."""
    sides = [
        d.select(key, *[F.col(f"{s}_logprob").alias(f"{model}_{s}_logprob") for s in ("chosen", "rejected")])
        for model, d in (("policy", policy), ("ref", reference))
    ]
    return sides[0].join(sides[1], key)
